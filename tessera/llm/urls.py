"""URL filter by a path-template tree with smoothed labelled purity (DataFrame functions only).

Per host, path segments form a tree. Level by level, a child segment stays literal if it has enough rows of its own and
a fixed share of its parent's rows (so a node has at most 1 / share literal children); all others become `*`. The tree is
as deep as the longest path, up to LEVELS; what lies below is `**`. Then, from the deepest level up, sibling templates (that
differ at one level only) whose labelled block rates do not differ significantly from the others' (two-proportion z test)
are merged to one branch, `~`, which pools their labels and takes part in the merges above. A template is rejected if the
smoothed share of blocked rows among its labelled rows reaches `reject_at`; the labels are the verdicts of the listed rules.

Cases: a null url or one without `://` has empty host and path and belongs to the template of its own empty host; a
path without segments has the template of the host's root; equal urls get equal verdicts; an empty table gives an empty
result; other columns are ignored. Templates with fewer labelled rows than `least_labels` are not merged; without labelled
rows a template keeps the prior and is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, save, table

#: (verdict, host, path) in no order; the longest that fits decides.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = 8


def parsed(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def literal(rows: DataFrame, have: list[str], least_rows: int, share: float) -> DataFrame:
    """rows(host, .., _seg) -> the (have.., _seg) that stay literal."""
    kids = rows.where("_seg is not null").groupBy(*have, "_seg").agg(F.count("*").alias("_n"))
    # a node's rows: summed over its literal and other children after pre-aggregation
    whole = kids.groupBy(*have).agg(F.sum("_n").alias("_all"))
    kept = kids.where(F.col("_n") >= least_rows).join(whole.where(F.col("_all") >= least_rows), [*have], "inner")
    kept = kept.where(F.col("_n") >= share * F.col("_all"))
    return save(kept.select(*have, "_seg", F.lit(True).alias("_literal")), "urls_literal")


def templates(rows: DataFrame, depth: int, least_rows: int = 10, share: float = 0.05) -> DataFrame:
    """rows(host, segs, ...) -> + t1..t<depth>: each level literal, `*`, or empty below the path's end; deep: `**` or ''."""
    have: list[str] = ["host"]
    for k in range(1, depth + 1):
        rows = rows.withColumn("_seg", F.get("segs", F.lit(k - 1)))
        rows = checked_join(rows, literal(rows, have, least_rows, share), [*have, "_seg"], "left")
        own = F.when(F.col("_literal"), F.concat(F.lit("/"), F.col("_seg"))).otherwise(F.lit("/*"))
        rows = rows.withColumn(f"t{k}", F.when(F.col("_seg").isNull(), F.lit("")).otherwise(own)).drop("_seg", "_literal")
        have.append(f"t{k}")
    return rows.withColumn("deep", F.when(F.size("segs") > depth, F.lit("/**")).otherwise(F.lit("")))


def merged(stats: DataFrame, depth: int, z: float, least_labels: int) -> DataFrame:
    """stats(host, t1.., deep, lab, bad) -> + m1..m<depth>: similar siblings are `~`, from the deepest level up."""
    for k in range(1, depth + 1):
        stats = stats.withColumn(f"m{k}", F.col(f"t{k}"))
    names = [f"m{k}" for k in range(1, depth + 1)]
    for k in range(depth, 0, -1):
        own = Window.partitionBy("host", *names, "deep")
        siblings = Window.partitionBy("host", *[m for m in names if m != f"m{k}"], "deep")
        stats = stats.withColumn("_l", F.sum("lab").over(own)).withColumn("_b", F.sum("bad").over(own))
        enough = (F.col("_l") >= least_labels) & (F.col(f"m{k}") != "")
        stats = stats.withColumn("_ol", F.sum(F.when(enough, F.col("lab"))).over(siblings) - F.col("_l"))
        stats = stats.withColumn("_ob", F.sum(F.when(enough, F.col("bad"))).over(siblings) - F.col("_b"))
        lab, bad, other, worse = (F.col(c).cast("double") for c in ("_l", "_b", "_ol", "_ob"))
        pooled, gap = (bad + worse) / (lab + other), bad / lab - worse / other
        error2 = pooled * (1 - pooled) * (F.lit(1.0) / lab + F.lit(1.0) / other)
        same = F.coalesce(F.when(enough & (F.col("_ol") > 0), gap * gap <= z * z * error2), F.lit(False))
        stats = stats.withColumn(f"m{k}", F.when(same, F.lit("/~")).otherwise(F.col(f"m{k}"))).drop("_l", "_b", "_ol", "_ob")
    return stats


def verdicts(rows: DataFrame, depth: int, prior: float = 0.1, strength: float = 2.0, reject_at: float = 0.8, z: float = 1.96, least_labels: int = 5) -> DataFrame:
    """rows(host, t1.., deep, label 1 block / 0 allow / null) -> per template: merged template, purity double, reject boolean."""
    keys = ["host", *[f"t{k}" for k in range(1, depth + 1)], "deep"]
    stats = rows.groupBy(*keys).agg(F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    stats = merged(stats, depth, z, least_labels)
    names = [f"m{k}" for k in range(1, depth + 1)]
    own = Window.partitionBy("host", *names, "deep")
    stats = stats.withColumn("purity", (F.sum("bad").over(own) + prior * strength) / (F.sum("lab").over(own) + strength))
    return stats.select(*keys, F.concat(F.lit(""), *names, "deep").alias("template"), "purity", (F.col("purity") >= reject_at).alias("reject"))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, **options) -> DataFrame:
    """pages + host, path, rule, template, purity, verdict; columns of these names in pages give way."""
    host, path = parsed(F.col(url_col))
    own = [pages[c] for c in pages.columns if c not in ("host", "path", "rule", "template", "purity", "verdict")]
    rows = pages.select(F.struct(*own).alias("_page"), host.alias("host"), path.alias("path")).withColumn("_rule", ruled(F.col("host"), F.col("path"), rules))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = rows.withColumn("label", F.when(F.col("_rule.verdict") == "block", 1).when(F.col("_rule.verdict") == "allow", 0))
    rows = save(rows.withColumn("segs", segs), "urls")
    depth = min(LEVELS, rows.agg(F.coalesce(F.max(F.size("segs")), F.lit(0))).first()[0])
    rows = templates(rows, depth, **{k: v for k, v in options.items() if k in ("least_rows", "share")})
    keys = ["host", *[f"t{k}" for k in range(1, depth + 1)], "deep"]
    found = save(verdicts(rows, depth, **{k: v for k, v in options.items() if k not in ("least_rows", "share")}), "urls_verdicts")
    rows = checked_join(rows, found, keys, "left")
    learned = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("_page.*", "host", "path", F.col("_rule.rule").alias("rule"), "template", "purity", F.coalesce(F.col("_rule.verdict"), learned).alias("verdict"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))


def _level(k: int) -> str:
    have = ", ".join(["host", *[f"t{i}" for i in range(1, k)]])
    n, whole = f"count(*) over (partition by {have}, segs[{k}])", f"count(segs[{k}]) over (partition by {have})"
    return f"""l{k} as (select *, case when segs[{k}] is null then '' when n >= 10 and n >= cast(0.05 as double) * a then '/' || segs[{k}] else '/*' end t{k}
  from (select * exclude (n, a), {n} n, {whole} a from l{k - 1}))"""


def _names(letter: str, but: int = 0) -> str:
    return ", ".join(f"{letter}{k}" for k in range(1, LEVELS + 1) if k != but)


def _merge(k: int) -> str:
    before = "s" if k == LEVELS else f"c{k + 1}"
    rest = f"partition by host, {_names('m', k)}, deep"
    return f"""a{k} as (select *, sum(lab) over w l, sum(bad) over w b from {before} window w as (partition by host, {_names('m')}, deep)),
b{k} as (select *, l >= 5 and m{k} <> '' en, cast(sum(case when l >= 5 and m{k} <> '' then lab end) over w - l as double) ol,
  cast(sum(case when l >= 5 and m{k} <> '' then bad end) over w - b as double) ob from a{k} window w as ({rest})),
g{k} as (select *, (b + ob) / (cast(l as double) + ol) pool, cast(b as double) / cast(l as double) - ob / ol gap from b{k}),
c{k} as (select * exclude (l, b, en, ol, ob, pool, gap) replace (case when coalesce(case when en and ol > 0 then
    gap * gap <= cast(1.96 as double) * cast(1.96 as double) * (pool * (1 - pool) * (1 / cast(l as double) + 1 / ol)) end, false) then '/~' else m{k} end as m{k}) from g{k})"""


ORACLE_SQL = rf"""
with r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select *, regexp_extract(rest, '^[^/?#]*') h0 from (select page_id, coalesce(rest, '') rest from r)),
p as (select page_id, translate(h0, '{UPPER}', '{LOWER}') host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') path from h),
v as (
  select *, case
    when (host = 'example.com' or host like '%.example.com') and path like '/en/7%' then 'example.com/en/7'
    when (host = 'example.net' or host like '%.example.net') and path like '/de/8%' then 'example.net/de/8'
    when (host = 'com' or host like '%.com') and path like '/en/%' then 'com/en/'
    when (host = 'net' or host like '%.net') and path like '/de/%' then 'net/de/'
    when (host = 'org' or host like '%.org') and path like '/es/%' then 'org/es/' end rule from p),
l0 as (
  select *, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 1 when rule is not null then 0 end label,
    list_filter(string_split(path, '/'), lambda s : s <> '') segs, 0 n, 0 a from v),
{", ".join(_level(k) for k in range(1, LEVELS + 1))},
d as (select *, case when len(segs) > {LEVELS} then '/**' else '' end deep from l{LEVELS}),
s as (select host, {", ".join(f"t{k}, t{k} m{k}" for k in range(1, LEVELS + 1))}, deep, count(label) lab, coalesce(sum(label), 0) bad from d group by all),
{", ".join(_merge(k) for k in range(LEVELS, 0, -1))},
q as (select *, (sum(bad) over w + cast(0.2 as double)) / (sum(lab) over w + cast(2 as double)) purity from c1 window w as (partition by host, {_names("m")}, deep))
select page_id, host, path, rule,
  case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow' when purity >= 0.8 then 'block' else 'allow' end verdict,
  {" || ".join(f"m{k}" for k in range(1, LEVELS + 1))} || deep as template, round(purity, 9) purity
from d join q using (host, {_names("t")}, deep)
"""
