"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target number of words. Whole copies come first: every document of a source is taken
floor(target / source size) times. For the words left, each document has an inclusion probability of its own, in
proportion to its size: p = min(1, c * size), with c such that the expected words are the words left. Documents with
p = 1 are certain of one more copy. For the others each draws a uniform u from its id and gets the Pareto rank
q = (u / (1 - u)) / (p / (1 - p)); documents with the smallest ranks are taken until the words left are used up. The
sample's fixed size is counted in words, and the last gap is filled with the one untaken document whose size fits it best.

Neither c nor the cut needs a source gathered: c comes from one row per (source, document size), the cut from words per
(source, rank bin), of which only the one bin that holds the cut is ordered. Both leave as a few numbers a source, which a
narrow filter applies.

Cases: null or empty text has size 0; null source is a source of its own, last in order; rows with equal id and source
are taken or left together; an empty table gives an empty mix; other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, save, table

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_col: str, source_col: str, text_col: str, seed: int) -> Column:
    """Uniform in (0, 1), fixed by id and source (by the text where the id is null)."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), name, F.lit("|"), F.coalesce(F.col(source_col), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_key(source_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """(_key, source_size) -> + target, capped: weighted shares of share[0]/share[1] of all words, filled up to `most` times each size."""
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy("_key")) - 1)
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("source_size").cast("double") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_used", F.coalesce(F.sum("source_size").over(by_fill), F.lit(0)) * most)
        .withColumn("_left", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(by_fill), F.lit(0)))
    )
    room = F.col("_all").cast("double") * share[0] - F.col("_used").cast("double") * share[1]
    full = F.col("source_size").cast("double") * (most * share[1]) * F.col("_left").cast("double") <= F.col("_w").cast("double") * room
    ranked = ranked.withColumn("capped", full)
    used = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0)) * most
    rest = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("_w"))).over(everything), F.lit(0))
    level = (F.col("_all") * share[0] - used * share[1]).cast("double") / F.when(rest > 0, rest * share[1]).cast("double")
    return ranked.select("_key", "source_size", "capped", F.when(F.col("capped"), (F.col("source_size") * most).cast("double")).otherwise(F.col("_w").cast("double") * level).alias("target"))


def odds() -> Column:
    """Inclusion probability of the fractional copy: in proportion to the size, 1 for documents that are certain."""
    size = F.col("_size").cast("double")
    return F.when(F.col("_words") <= 0, F.lit(0.0)).when(F.col("_size") >= F.col("_certain"), F.lit(1.0)).otherwise(F.col("_rate") * size)


def rank() -> Column:
    """Pareto rank of the fractional copy; null where there is none or it is certain."""
    u, p = F.col("_draw"), odds()
    return F.when((p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))


def rates(narrow: DataFrame, goal: DataFrame) -> DataFrame:
    """goal + _certain (least size that is taken for certain, null: none), _rate (p of the others is _rate * size), _left (words for them).

    A size is certain if, with all larger ones certain, its share of the words left would reach one document.
    """
    sizes = narrow.where("_size > 0").groupBy("_key", "_size").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy("_key").orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("_key").orderBy(F.desc("_size")).rowsBetween(Window.unboundedPreceding, -1)
    words, squares = (F.col("_n") * F.col("_size")).cast("decimal(20,0)"), F.col("_n").cast("decimal(20,0)") * (F.col("_size") * F.col("_size")).cast("decimal(18,0)")
    sizes = sizes.withColumn("_squares", F.sum(squares).over(upto).cast("double")).withColumn("_above", F.coalesce(F.sum(words).over(above), F.lit(0)).cast("double"))
    sizes = sizes.join(goal.select("_key", "_words"), "_key").withColumn("_left", F.col("_words") - F.col("_above"))
    full = (F.col("_words") > 0) & (F.col("_size").cast("double") * F.col("_left") >= F.col("_squares"))
    certain = sizes.where(full).groupBy("_key").agg(F.min("_size").alias("_certain"))
    rest = sizes.where(~full).groupBy("_key").agg(F.max(F.struct("_size", "_left", "_squares")).alias("_top"))
    rest = rest.select("_key", (F.col("_top._left") / F.col("_top._squares")).alias("_rate"), F.col("_top._left").alias("_left"))
    out = goal.join(certain, "_key", "left").join(rest, "_key", "left")
    none = F.lit((1 << 63) - 1)
    return out.select(*goal.columns, F.coalesce("_certain", none).alias("_certain"), F.coalesce("_rate", F.lit(0.0)).alias("_rate"), F.coalesce("_left", F.lit(0.0)).alias("_left"))


GOAL = ("_words", "_certain", "_rate")


def plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 7, bins: int = 4096,
         id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The narrow rows (id, _key, _draw, _size), and per source: source_size, target, _whole, the odds' numbers, cut and top ranks."""
    narrow = docs.select(F.col(id_col), source_key(source_col).alias("_key"), draw(id_col, source_col, text_col, seed).alias("_draw"), words(F.col(text_col)).alias("_size"))
    narrow = save(narrow, "mix")
    goal = targets(narrow.groupBy("_key").agg(F.sum("_size").alias("source_size")), weights, share, most)
    size = F.col("source_size").cast("double")
    whole = F.when(F.col("capped"), F.lit(most)).when(F.col("source_size") > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int")
    goal = goal.withColumn("_whole", whole).withColumn("_words", F.col("target") - F.col("_whole") * size)
    goal = save(rates(narrow, goal), "mix_goal")
    sources = goal.count()
    ranked = checked_join(narrow, goal.select("_key", *GOAL, "_left"), "_key", "inner", sources).withColumn("_rank", rank()).where("_rank is not null")
    ranked = ranked.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * bins).cast("int"))
    upto = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    held = ranked.groupBy("_key", "_bin").agg(F.sum("_size").alias("_n"), F.first("_left").alias("_left")).withColumn("_upto", F.sum("_n").over(upto))
    edge = held.where("_upto > _left").groupBy("_key").agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("_before")), "_bin").alias("_edge"))
    edge = save(edge.select("_key", "_edge.*").withColumnRenamed("_bin", "_edge_bin"), "mix_edge")
    near = checked_join(ranked, edge, "_key", "left", sources)
    run = F.col("_before") + F.sum("_size").over(Window.partitionBy("_key").orderBy("_rank").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    inside = near.where("_bin = _edge_bin").withColumn("_run", run).where("_run <= _left").groupBy("_key").agg(F.max("_rank").alias("_in"), F.max("_run").alias("_sum"))
    below = near.where("_edge_bin is null or _bin < _edge_bin").groupBy("_key").agg(F.max("_rank").alias("_below"), F.sum("_size").alias("_below_sum"))
    cut = goal.select("_key", *GOAL, "_left").join(below, "_key", "left").join(inside, "_key", "left")
    gap = F.col("_left") - F.coalesce("_sum", "_below_sum", F.lit(0))
    cut = save(cut.select("_key", *GOAL, F.coalesce("_in", "_below", F.lit(-1.0)).alias("_cut"), gap.alias("_gap")), "mix_cut")
    spare = checked_join(narrow, cut, "_key", "inner", sources).withColumn("_rank", rank()).where("_rank > _cut and abs(_gap - _size) < _gap")
    top = spare.groupBy("_key").agg(F.min(F.struct(F.abs(F.col("_gap") - F.col("_size")).alias("d"), "_rank")).getField("_rank").alias("_top"))
    done = goal.drop("_left").join(cut.select("_key", "_cut"), "_key").join(top, "_key", "left")
    return narrow, save(done, "mix_done")


def copies() -> Column:
    """How often the mix takes a row."""
    drawn = F.coalesce((F.col("_rank") <= F.col("_cut")) | F.coalesce(F.col("_rank") == F.col("_top"), F.lit(False)), F.lit(False))
    return F.col("_whole") + (drawn | (odds() >= 1)).cast("int")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, **options) -> DataFrame:
    """The mixed corpus: docs with every row repeated as often as the mix takes it."""
    _, done = plan(docs, id_col=id_col, source_col=source_col, text_col=text_col, seed=seed, **options)
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), source_key(source_col).alias("_key"), draw(id_col, source_col, text_col, seed).alias("_draw"), words(F.col(text_col)).alias("_size"))
    taken = checked_join(inner, done, "_key", "left").withColumn("_rank", rank()).withColumn("_copies", copies()).where("_copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_doc.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    narrow, done = plan(table(spark, sf_dir, "documents"))
    taken = checked_join(narrow, done, "_key", "left").withColumn("_rank", rank())
    return taken.select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * copies()).cast("long").alias("taken"))


ORACLE_SQL = r"""
with n as (
  select doc_id, coalesce('=' || source, '~') k, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size,
    (cast(cast('0x' || substr(md5('7|' || coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) || '|' || coalesce(source, '')), 1, 13) as bigint) as double) + cast(0.5 as double)) / cast(4503599627370496 as double) u
  from documents),
s as (select k, cast(sum(size) as bigint) s from n group by k),
r as (select *, row_number() over (order by k) - 1 r, [3, 1, 2][cast((row_number() over (order by k) - 1) % 3 + 1 as int)] w from s),
f as (
  select *, sum(s) over () tot,
    coalesce(sum(s) over (order by cast(s as double) / w, r rows between unbounded preceding and 1 preceding), 0) * 2 used,
    sum(w) over () - coalesce(sum(w) over (order by cast(s as double) / w, r rows between unbounded preceding and 1 preceding), 0) rest from r),
c as (select *, cast(s as double) * 4 * cast(rest as double) <= cast(w as double) * (cast(tot as double) * 3 - cast(used as double) * 2) capped from f),
l as (
  select *, cast(tot * 3 - coalesce(sum(case when capped then s end) over (), 0) * 2 * 2 as double)
    / cast(nullif(coalesce(sum(case when not capped then w end) over (), 0), 0) * 2 as double) lvl from c),
t as (select k, s, capped, case when capped then cast(s * 2 as double) else cast(w as double) * lvl end target from l),
g as (select *, case when capped then 2 when s > 0 then cast(floor(target / cast(s as double)) as int) else 0 end whole from t),
p as (select *, target - whole * cast(s as double) wds from g),
z as (select k, size, count(*) c from n where size > 0 group by 1, 2),
zz as (
  select z.*, wds, wds - cast(coalesce(sum(c * size) over (partition by k order by size desc rows between unbounded preceding and 1 preceding), 0) as double) lft,
    cast(sum(cast(c as hugeint) * (size * size)) over (partition by k order by size rows unbounded preceding) as double) sq from z join p using (k)),
zf as (select *, wds > 0 and cast(size as double) * lft >= sq full_ from zz),
ra as (
  select p.*, (select min(size) from zf where zf.k = p.k and full_) sure,
    coalesce((select arg_max(lft / sq, size) from zf where zf.k = p.k and not full_), 0) rate,
    coalesce((select arg_max(lft, size) from zf where zf.k = p.k and not full_), 0) lft from p),
o as (select n.*, s, target, whole, lft, case when wds <= 0 then cast(0 as double) when size >= sure then cast(1 as double) else rate * cast(size as double) end p from n join ra using (k)),
x as (select *, case when p > 0 and p < 1 then (u / (1 - u)) / (p / (1 - p)) end q from o),
y as (select *, sum(size) over (partition by k order by q range between unbounded preceding and current row) run from x where q is not null),
cut as (select k, max(case when run <= lft then q end) c, any_value(lft) - coalesce(max(case when run <= lft then run end), 0) gap from y group by k),
tops as (
  select k, q from (
    select y.k, q, row_number() over (partition by y.k order by abs(gap - size), q) rn from y join cut using (k)
    where q > coalesce(c, -1) and abs(gap - size) < gap) where rn = 1)
select x.doc_id, x.size, x.s as source_size, x.target,
  cast(x.size * (x.whole + case when x.p >= 1 or x.q <= coalesce(cut.c, -1) or x.q = tops.q then 1 else 0 end) as bigint) as taken
from x left join cut on x.k = cut.k left join tops on x.k = tops.k
"""
