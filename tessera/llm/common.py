"""Shared pieces of the corpus operators: tables, shared storage, checked joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Measured bytes of a table that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Lists of the paths saved inside each open `scratch`, the innermost last.
_OPEN: list[list[str]] = []


def save(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end, but for the one saved last, which must be all that is still needed."""
    _OPEN.append([])
    try:
        yield
    finally:
        *done, last = _OPEN.pop() or [None]
        if _OPEN and last:
            _OPEN[-1].append(last)
        for path in done:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = 512, most_bytes: int = 16 << 20) -> None:
    """Bound what one Arrow batch of whole texts can hold, by rows and by bytes, for the session's later queries."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def weight(df: DataFrame) -> int:
    """Bytes of df's rows: counted rows by their fixed columns, and the measured length of strings, binaries and arrays."""
    flat = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in flat.items() if kind in ("string", "binary")]
    long += [F.coalesce(F.size(c), F.lit(0)) * 8 for c, kind in flat.items() if kind.startswith("array")]
    row = df.agg(F.count("*"), *[F.sum(x) for x in long]).first()
    return row[0] * (16 + 8 * len(flat)) + sum(x or 0 for x in row[1:])


def checked_join(big: DataFrame, small: DataFrame, on, how: str, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts `small` only if its measured bytes stay under `limit`; else Spark shuffles (AQE splits hot keys).

    `rows`: their number, where known, for a table of numbers only.
    """
    held = weight(small) if rows is None else rows * (16 + 8 * len(small.columns))
    return big.join(F.broadcast(small) if held <= limit else small.hint("merge"), on, how)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of a batch with about `most` bytes of text (one row at least), with the texts as UTF-8 (null: None)."""
    texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
    at, size = 0, 0
    values: list[bytes | None] = []
    for i in range(len(texts)):
        v = texts[i].as_py()
        values.append(v)
        size += len(v or b"")
        if size >= most:
            yield batch.slice(at, i + 1 - at), values
            at, size, values = i + 1, 0, []
    if values:
        yield batch.slice(at), values


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def drawn(rows: DataFrame, label_col: str, key: list[str], each: int) -> DataFrame:
    """About `each` rows of every label (all of a label that has fewer), chosen by a hash of the columns `key`; labels are few.

    The sample is at most 2 * `each` rows a label.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(label_col).isNotNull()).groupBy(label_col).count().collect()}
    if not counts:
        return rows.limit(0)
    odds = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, min(1.0, each / n))])
    some = rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 20)) < odds[F.col(label_col)] * (1 << 20))
    return some.orderBy(F.xxhash64(*key), *key).limit(2 * each * len(counts))


def excerpt(text: Column, most_bytes: int, parts: int = 8) -> Column:
    """The whole text up to `most_bytes` bytes; of a longer one, windows of that size together, spread evenly over it."""
    size = most_bytes // (4 * parts)  # a character has at most four bytes
    step = (F.length(text) - size).cast("double") / (parts - 1)
    windows = [F.substr(text, F.floor(step * k).cast("int") + 1, F.lit(size)) for k in range(parts)]
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.concat_ws(" ", *windows))


#: Edges of a component search that one file (and so one task's last step) may hold.
EDGES_A_FILE = 500_000
#: Edges (16 bytes each) that one task may unite.
FEW_EDGES = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of one task."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = x = above[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            low, high = sorted((root(a), root(b)))
            above[high] = low
    nodes = sorted(above)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, name: str = "components", few: int = FEW_EDGES) -> DataFrame:
    """Connected components of an undirected edge list (a, b: long, not null) as (node, component), component the least node.

    Up to `few` counted edges are united in one task. More take alternating large-star and small-star steps: minima are
    pre-aggregated per node, then joined to the edges, so a hub is split by the skew join and never gathered. Each step is
    written to the shared folder.
    """
    with scratch(edges.sparkSession):
        edges = save(edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b").distinct(), name)
        count = edges.count()
        if count <= few:
            return save(edges.coalesce(1).mapInArrow(_united, "node long, component long"), name)
        files = count // EDGES_A_FILE + 1
        while count:
            # large star: every larger neighbour of u hangs on the least node around u
            both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
            large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
            # small star: u and its lesser neighbours hang on the least of them
            down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
            mins = down.groupBy("u").agg(F.min("v").alias("m"))
            new = down.join(mins, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(mins.select(F.col("m").alias("a"), F.col("u").alias("b")))
            edges = save(new.where("a < b").distinct().coalesce(files), name)
            # stars: no node hangs on two, and none that hangs on one is another's middle
            row = edges.agg(F.count("*"), F.count_distinct("b")).first()
            if row[0] == row[1] and edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
                break
    roots = edges.select(F.col("a").alias("node")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots.select("node", F.col("node").alias("component")))
