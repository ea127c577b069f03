"""SimHash near-duplicates with Golay-code fuzzy keys.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits, each a word of the perfect [23,12] Golay code
(padded with zeros). A word decodes to the one codeword within 3 bits; a word 3 bits away from its codeword has exactly
five more codewords at 4 bits. So if two words differ in at most one bit, the codeword of the one is among the (one or
six) codewords within 4 bits of the other; if they differ in at most two, they share such a codeword. With at most 3
differing bits in all, two of the three segments differ in at most one bit each (pigeonhole), so an index key made of
two decoded segments meets the other fingerprint's product of nearby codewords. Joined candidates are verified by
their real distance inside the join, so only true links leave it. Components of links are found by star contraction.

Only distinct fingerprints are joined: copies cost one row. Cases: null or empty text has fingerprint zero; a text with
fewer words than a shingle is one shingle; rows with a null id count for the fingerprint but name no component unless
all ids are null; an empty table gives an empty result; other columns pass through or are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, components, save, scratch, slices, small_batches, table

CUTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def shingle_hashes(text: bytes | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    import xxhash

    words = (text or b"").translate(FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(words) - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set if set in over half the hashes; signed 64-bit."""
    if not len(hashes):
        return 0
    columns = hashes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.intp) + np.arange(8) * 256
    counts = np.bincount(columns.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
    return int(np.packbits((counts * 2 > len(hashes)).ravel(), bitorder="little").view("<i8")[0])


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each of three bytes modulo the generator, and the error pattern of each of the 2048 remainders."""

    def rest(x: int) -> int:
        for k in range(23, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    bits = [rest(1 << i) for i in range(24)]
    remainder = np.zeros((3, 256), np.int64)
    for part in range(3):
        for v in range(256):
            for i in range(8):
                if v >> i & 1:
                    remainder[part, v] ^= bits[part * 8 + i]
    errors = np.zeros(2048, np.int64)
    for a in range(23):
        for b in range(a, 23):
            for c in range(b, 23):
                pattern = (1 << a) | (1 << b) | (1 << c)
                s = 0
                for i in {a, b, c}:
                    s ^= bits[i]
                errors[s] = pattern
                if a == b == c:
                    continue
    return remainder, errors


REMAINDER, ERRORS = golay_tables()


def decode(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword within 3 bits of each 23-bit word."""
    s = REMAINDER[0][words & 255] ^ REMAINDER[1][(words >> 8) & 255] ^ REMAINDER[2][(words >> 16) & 255]
    return (words ^ ERRORS[s]) >> 11


def nearby(words: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits, -1 where there are fewer; the word's own codeword is first."""
    own = decode(words)
    around = np.sort(decode(words[:, None] ^ (1 << np.arange(23))[None, :]), axis=1)
    new = np.ones(around.shape, bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    new &= around != own[:, None]
    out = np.full((len(words), 6), -1, np.int64)
    out[:, 0] = own
    row, col = np.nonzero(new)
    place = (np.cumsum(new, axis=1))[row, col]
    out[row, place] = around[row, col]
    return out


def keys(fps: np.ndarray, index: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys): one key per pair of segments for the index side, all products of nearby codewords else."""
    u = fps.astype(np.int64).view(np.uint64)
    segments = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in CUTS]
    near = [decode(s)[:, None] if index else nearby(s) for s in segments]
    rows, out = [], []
    for p, (a, b) in enumerate(PAIRS):
        left, right = near[a][:, :, None], near[b][:, None, :]
        both = (p << 24) | (left << 12) | right
        ok = np.broadcast_to((left >= 0) & (right >= 0), both.shape)
        rows.append(np.nonzero(ok)[0])
        out.append(both[ok])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(index: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, found = keys(part, index)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["key", "fp"])

    return run


def links(fps: DataFrame, distance: int = 3, wide: bool = False) -> DataFrame:
    """Distinct fingerprints (fp long) -> linked pairs (a < b); `wide` uses nearby codewords on both sides, which reaches further."""
    index = fps.select("fp").mapInArrow(_keyed(not wide), "key long, fp long").withColumnRenamed("fp", "a")
    query = fps.select("fp").mapInArrow(_keyed(False), "key long, fp long").withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return index.hint("merge").join(query, (index["key"] == query["key"]) & near).select("a", "b").distinct()


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                fps = np.fromiter((fingerprint(shingle_hashes(t, width)) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fp long")


def near_groups(docs: DataFrame, width: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the least id reachable over links of at most `distance` bits."""
    fps = save(fingerprints(docs, width, id_col, text_col), "simhash_fp")
    classes = save(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash_classes")
    found = save(components(links(classes, distance), "simhash_links"), "simhash_components")
    grouped = checked_join(classes, found.withColumnRenamed("node", "fp"), "fp", "inner")
    roots = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(roots, "component").select("fp", "component_id")
    named = save(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash_named")
    return checked_join(fps, named, "fp", "inner").select(id_col, "fp", "component_id")


SAMPLE_TEXTS, SAMPLE_SHARE, COMMON = 20_000, 1 / 64, 200_000
#: Bits of a text's priority, size and place in one long, so that an indexed shingle is three longs.
SIZE_BITS, PLACE_BITS, TIMES_BITS = 26, 24, 13
#: Least and greatest numbers of parity bits of a text (powers of two; about two bits a shingle between).
LEAST_BITS, MOST_BITS = 256, 1 << 17
#: Share of all shingles, by hash, whose exact numbers of texts order the first index; the second index takes all shingles.
EARLY = 0.3
#: Texts of a bucket that meet the whole bucket in a round after the two hubs; each later round takes so many times as many.
FIRST_ROUND = 8


def identity(text_col: str) -> list[Column]:
    """(h, c): two checksums that stand for a whole text (null: the empty one)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c")]


def common_shingles(docs: DataFrame, words: int, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several distinct texts of a sample hold, and in how many (at most COMMON of them).

    They only set the order in which a text's shingles are indexed and by which plan their buckets are read, so what the
    sample misses costs time and no pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch, text_col):
                for t in texts:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], ["key"])

    share = min(1.0, max(SAMPLE_SHARE, SAMPLE_TEXTS / max(1, docs.count())))
    same = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    some = docs.select(text_col, same.alias("same")).where(F.pmod("same", F.lit(1 << 20)) < share * (1 << 20))
    some = some.groupBy("same").agg(F.first(text_col).alias(text_col)).select(text_col)
    rows = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").cast("int").alias("n")).where("n > 2")
    found = rows.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys, n = found.column("key").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], least: float, share: float) -> tuple[np.ndarray, int, np.ndarray]:
    """What a set (sorted, distinct) gives to the index: (rare, early, hot).

    One order of shingles holds for all texts: those not in `common` with a hash in the first `share` of all hashes, by the
    number of texts that have them; the rest of those not in `common`, by hash; the common ones. Sets of `least` similarity
    share at least ceil(least * size) shingles, so one of the first size - that + 1 of each. The numbers are known only in
    the index (see buckets), so `rare` holds all `early` ones that they order, and others as far as the prefix may reach.
    """
    keys, n = common
    seen = np.zeros(len(shingles), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
        seen = np.where(keys[at] == shingles, n[at], 0)
    most = len(shingles) - int(np.ceil(least * len(shingles) - 1e-9)) + 1 if len(shingles) else 0
    known = seen > 0
    rare, hot = shingles[~known], shingles[known]
    early = int(np.count_nonzero((rare >> np.uint64(32)) < np.uint64(share * (1 << 32))))
    hot = hot[np.lexsort((hot, seen[known]))][: max(0, most - len(rare))]
    return rare[: max(early, most)], early, hot


def parities(shingles: np.ndarray) -> bytes:
    """Bits, each the parity of the number of shingles that fall on it: two sets differ in at least as many shingles as bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(shingles) - 1).bit_length() if len(shingles) else 0))
    odd = np.bincount((shingles >> np.uint64(17)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Bits in which two parities differ; the longer one is folded to the shorter one's length."""
    a, b = (np.frombuffer(v, np.uint64) for v in sorted((x, y), key=len))
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _maybe_similar(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = ((batch.column(2).to_numpy() + batch.column(3).to_numpy()) * ((1 - least) / (1 + least)) + 1e-6).tolist()
            keep = [parity_distance(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _indexed(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray], least: float, share: float) -> list[pa.Array]:
    """Columns early, rare and hot of `prefix`."""
    rare, early, hot = zip(*(prefix(s, common, least, share) for s in sets), strict=True)
    return [pa.array(early, pa.int64()), *(pa.array([x.view(np.int64) for x in side], pa.list_(pa.int64())) for side in (rare, hot))]


def classes(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], least: float, words: int, id_col: str, text_col: str) -> DataFrame:
    """One row a distinct text: node, h, c, least id, info (how often it is there, shingles), fp, shingles of `prefix`, parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                hashes = [shingle_hashes(t, words) for t in texts]
                fps = np.fromiter(map(fingerprint, hashes), np.int64, len(texts))
                sets = [np.unique(h) for h in hashes]
                bits = pa.array([parities(s) for s in sets], pa.binary())
                sizes = pa.array([len(s) for s in sets], pa.int64())
                columns = [*part.columns[:3], sizes, pa.array(fps), *_indexed(sets, common, least, EARLY), bits]
                yield pa.RecordBatch.from_arrays(columns, ["id", "h", "c", "size", "fp", "early", "rare", "hot", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), *identity(text_col), text_col)
    seen = texts.mapInArrow(run, f"id {kind}, h long, c long, size long, fp long, early long, rare array<long>, hot array<long>, bits binary")
    one = seen.groupBy("h", "c").agg(F.min("id").alias("least"), F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("size", "fp", "early", "rare", "hot", "bits")])
    times = F.least("n", F.lit((1 << TIMES_BITS) - 1))
    info = F.shiftleft(times, SIZE_BITS + PLACE_BITS).bitwiseOR(F.shiftleft("size", PLACE_BITS))
    return save(one.select(F.monotonically_increasing_id().alias("node"), "h", "c", "least", "n", info.alias("info"), "fp", "early", "rare", "hot", "bits"), "dedup_classes")


def shingles_of(info: str) -> Column:
    return F.shiftrightunsigned(info, PLACE_BITS).bitwiseAND((1 << SIZE_BITS) - 1)


def priority(info: str = "info") -> Column:
    """Order of texts as hubs: often repeated ones first, then long ones; the same in every bucket, whatever the place."""
    return F.shiftrightunsigned(info, PLACE_BITS)


def rest(info: str) -> Column:
    """Shingles at a place and behind it."""
    return shingles_of(info) - F.col(info).bitwiseAND((1 << PLACE_BITS) - 1)


def close(x: str, y: str, least: float) -> Column:
    """Whether two sets that share a shingle at their places can still be similar: it and all behind it bound the overlap."""
    return F.least(rest(x), rest(y)) >= (shingles_of(x) + shingles_of(y)) * (least / (1 + least)) - 1e-6


def reach(info: str, least: float) -> Column:
    """The greatest size of a set that can be `close` to this one."""
    return rest(info) * ((1 + least) / least) - shingles_of(info) + 1e-3


def buckets(texts: DataFrame, least: float, share: float) -> DataFrame:
    """(key, node, info, hub, hub_info, members) of every prefix shingle that two or more texts share; hub: the most repeated.

    Shingles known to be common are few: their hubs are pre-aggregated and broadcast. The others are dealt by shingle to be
    counted; those that only one text has go, and what is left gets its places, text by text. Rows go that are `close` to no
    size in their bucket.
    """
    by_key, by_node = Window.partitionBy("key"), Window.partitionBy("node")
    late = F.shiftrightunsigned("key", 32) >= int(share * (1 << 32))
    rare = texts.select("node", F.explode("rare").alias("key"))
    rare = rare.select("node", "key", late.alias("late"), F.count("*").over(by_key).alias("members")).where("late or members > 1")
    rare = rare.select("node", "key", "late", F.when(F.col("late"), 0).otherwise(F.col("members")).alias("members"))
    most = shingles_of("info") - F.ceil(shingles_of("info") * least - 1e-9) + 1
    rare = rare.join(texts.select("node", "info", "early").hint("merge"), "node")
    single = F.col("early") - F.count(F.when(~F.col("late"), 1)).over(by_node)  # shingles that stand before all of these
    place = single + F.row_number().over(by_node.orderBy("late", "members", "key")) - 1
    rare = rare.select("key", "node", "info", place.cast("long").alias("place")).where(F.col("place") < most)
    rare = rare.select("key", "node", F.col("info").bitwiseOR(F.col("place")).alias("info"))
    first = by_key.orderBy(priority().desc(), "node")
    sizes = [F.count("*"), F.min(shingles_of("info")), F.max(reach("info", least))]
    names = ["members", "least_size", "most_reach"]
    rare = rare.select("key", "node", "info", F.first("node").over(first).alias("hub"), F.first("info").over(first).alias("hub_info"), *[x.over(by_key).alias(n) for x, n in zip(sizes, names, strict=True)])
    hot = texts.select("node", "info", F.size("rare").cast("long").alias("before"), F.posexplode("hot").alias("place", "key"))
    hot = hot.select("key", "node", F.col("info").bitwiseOR(F.col("place").cast("long") + F.col("before")).alias("info"))
    hubs = hot.groupBy("key").agg(F.max(F.struct(priority(), (-F.col("node")).alias("less"), "info")).alias("top"), *[x.alias(n) for x, n in zip(sizes, names, strict=True)])
    hubs = hubs.where("members > 1").select("key", (-F.col("top.less")).alias("hub"), F.col("top.info").alias("hub_info"), *names)
    hot = hot.join(F.broadcast(hubs), "key")  # at most COMMON rows
    both = rare.where("members > 1").unionByName(hot).where((F.col("least_size") <= reach("info", least)) & (shingles_of("info") <= F.col("most_reach")))
    return save(both.drop("least_size", "most_reach"), "dedup_buckets")


def golay_stars(texts: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints differ in at most `distance` bits, by Golay keys: each text meets the most
    repeated text of every index bucket that its nearby codewords name, and texts of one fingerprint meet one of them."""
    own = texts.groupBy("fp").agg(F.max(F.struct("info", (-F.col("node")).alias("less"))).alias("top"))
    own = save(own.select("fp", F.col("top.info").alias("info"), (-F.col("top.less")).alias("hub")), "dedup_fp")
    same = texts.select("fp", "node").join(own, "fp").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    index = own.select("fp").mapInArrow(_keyed(True), "key long, fp long").join(own, "fp")
    index = index.groupBy("key").agg(F.max(F.struct("info", (-F.col("hub")).alias("less"), "fp")).alias("top"))
    index = index.select("key", (-F.col("top.less")).alias("a"), F.col("top.fp").alias("fa"))
    query = own.select("fp").mapInArrow(_keyed(False), "key long, fp long")
    near = (F.col("fp") != F.col("fa")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fa"))) <= distance)
    # Spark takes the keys for as small as the fingerprints they come from; merged, they are not gathered at the driver
    across = query.join(index.hint("merge"), "key").where(near).select("a", "fp").distinct().join(own, "fp")
    return same.union(across.select("a", F.col("hub").alias("b")))


def near_components(texts: DataFrame, compare: Callable[[DataFrame], DataFrame], refined: Callable[[DataFrame], DataFrame], least: float, distance: int = 3) -> DataFrame:
    """Texts of `classes` -> (node, component) of those with a link of at least `least` similarity; `compare` leaves such pairs.

    First come pairs whose fingerprints meet by Golay keys. The similarity asked for reaches far beyond the bits that the
    code decodes, so all pairs that share a shingle of their prefixes follow, which every similar pair does: each bucket's
    texts meet its hub. Texts of buckets that still hold several components are indexed anew (`refined`), by the exact numbers
    of texts among them that have each shingle: every similar pair across components is among these texts, so it shares a
    shingle of the new prefixes too, while texts that differ in more shingles than similar sets may fill their prefixes with
    those. There each bucket's texts meet its hub, then its most central text (which shares most shingles of its prefix with
    others); then, while a bucket holds texts of several components, those outside its largest component meet all its other
    components, some at a time. Pairs inside a component are not compared: they could join nothing more.
    """
    held = buckets(texts, least, EARLY)
    met = save(held.select("node").distinct(), "dedup_members")
    tried = save(golay_stars(checked_join(texts, met, "node", "left_semi"), distance), "dedup_pairs")
    linked = compare(tried)
    found = save(components(linked, "dedup_components"), "dedup_found")

    def placed(rows: DataFrame) -> DataFrame:
        return checked_join(rows, found, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    def meet(pairs: DataFrame) -> None:
        """Compare pairs that were not tried yet, each once."""
        nonlocal tried, linked, found
        known = tried.union(tried.select("b", "a"))
        new = save(pairs.distinct().join(known, ["a", "b"], "left_anti"), "dedup_pairs")
        if new.isEmpty():
            return
        good = compare(new)
        tried = tried.union(new)
        if not good.isEmpty():
            linked = linked.union(good)
            found = save(components(linked, "dedup_components"), "dedup_found")

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of texts that are in another component than their bucket's hub."""
        other = found.select(F.col("node").alias("hub"), F.col("component").alias("_hub_part"))
        return checked_join(placed(rows), other, "hub", "left").where(F.col("part") != F.coalesce("_hub_part", "hub"))

    def meet_hubs(rows: DataFrame) -> DataFrame:
        """Rows of buckets in which several components are left once all texts have met their hubs."""
        star = apart(rows.where("node <> hub")).where(close("info", "hub_info", least))
        meet(star.select(F.col("hub").alias("a"), F.col("node").alias("b")))
        rows = rows.where("members > 2")
        return checked_join(rows, save(apart(rows).select("key").distinct(), "dedup_keys"), "key", "left_semi")

    nodes = save(meet_hubs(held).select("node").distinct(), "dedup_nodes")
    if nodes.isEmpty():
        return found
    held = meet_hubs(buckets(refined(nodes), least, 1.0))
    members = save(held.groupBy("node").agg(F.count("*").alias("degree")), "dedup_members")
    held = save(checked_join(held, members, "node", "inner").select("key", "node", "info", "degree", "hub"), "dedup_open")
    tested = held.select("key", F.col("hub").alias("node")).distinct()
    held, some, more = held.drop("hub"), 1, True
    while more:
        rows = placed(held)
        parts = rows.groupBy("key", "part").count()
        main = parts.groupBy("key").agg(F.max(F.struct("count", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        main = save(main.select("key", F.col("main.part").alias("main")), "dedup_main")
        if main.isEmpty():
            return found
        held = save(checked_join(rows, main, "key", "inner"), "dedup_open")
        # first the most central text of all, then those outside the largest component
        rest = (held if some == 1 else held.where("part <> main")).join(tested, ["key", "node"], "left_anti")
        rest = rest.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "node"))).where(F.col("turn") <= some + 1)
        rest = save(rest.select("key", F.col("node").alias("a"), F.col("info").alias("a_info"), F.col("part").alias("a_part"), "turn"), "dedup_turn")
        # once all outside the largest components have met the other ones, no two components of a bucket are left to meet
        more, turn = not rest.where(F.col("turn") > some).isEmpty(), rest.where(F.col("turn") <= some)
        met = held.join(turn, "key").where("part <> a_part").where(close("info", "a_info", least))
        meet(met.select("a", F.col("node").alias("b")))
        tested = tested.union(turn.select("key", F.col("a").alias("node")))
        unfinished = rest.where(F.col("turn") > some).select("key").distinct()
        held = checked_join(held.select("key", "node", "info", "degree"), unfinished, "key", "left_semi")
        some *= FIRST_ROUND
    return found


def reader(docs: DataFrame, texts: DataFrame, id_col: str, text_col: str) -> Callable[[DataFrame], DataFrame]:
    """A function that gives the whole texts of nodes: (node) -> (node, text), saved."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *identity(text_col))
    known = texts.select("node", F.col("h").alias("_h"), F.col("c").alias("_c"), F.col("least").alias("id"))

    def whole(nodes: DataFrame) -> DataFrame:
        wanted = checked_join(known, nodes, "node", "left_semi")
        got = checked_join(own.where("id is not null"), save(wanted.where("id is not null"), "dedup_wanted"), "id", "inner")
        bare = checked_join(own.where("id is null").drop("id"), wanted.where("id is null").drop("id"), (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c")), "inner")
        got = got.where("h = _h and c = _c").select("node", "text").union(bare.select("node", "text"))
        return save(got.groupBy("node").agg(F.first("text").alias("text")), "dedup_texts")

    return whole


def refiner(texts: DataFrame, whole: Callable[[DataFrame], DataFrame], common: tuple[np.ndarray, np.ndarray], words: int, least: float) -> Callable[[DataFrame], DataFrame]:
    """A function that gives the columns of `buckets` for nodes, with all their shingles that are not common as early ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in slices(batch):
                sets = [np.unique(shingle_hashes(t, words)) for t in values]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *_indexed(sets, common, least, 1.0)], ["node", "info", "early", "rare", "hot"])

    def refined(nodes: DataFrame) -> DataFrame:
        infos = checked_join(texts.select("node", "info"), nodes, "node", "left_semi")
        rows = checked_join(whole(nodes), infos, "node", "inner").select("node", "info", "text")
        return save(rows.mapInArrow(run, "node long, info long, early long, rare array<long>, hot array<long>"), "dedup_shingles")

    return refined


def comparer(texts: DataFrame, whole: Callable[[DataFrame], DataFrame], words: int, least: float) -> Callable[[DataFrame], DataFrame]:
    """A function that leaves of pairs (a, b) of nodes those whose shingle sets are similar.

    Pairs whose parities already differ in more shingles than similar sets can go first; the others' whole texts are read.
    """
    light = texts.select("node", shingles_of("info").alias("n"), "bits")

    def compare(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        few = save(checked_join(light, nodes, "node", "left_semi"), "dedup_light")
        both = pairs.join(few.toDF("a", "na", "bits_a"), "a").join(few.toDF("b", "nb", "bits_b"), "b")
        left = both.select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_maybe_similar(least), "a long, b long")
        left = save(left, "dedup_left")
        side = whole(left.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        both = left.join(side.toDF("b", "tb"), "b").join(side.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")
        return save(both.mapInArrow(_similar(words, least), "a long, b long"), "dedup_links")

    return compare


def _similar(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, mine = None, np.zeros(0, np.uint64)  # pairs come in runs of one hub
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if a != last:
                    last, mine = a, shingle_set(ta.as_py(), words)
                keep.append(similar(mine, shingle_set(tb.as_py(), words), least))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes((text or "").encode(), words))


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of shingle hashes have a Jaccard similarity of at least `least`."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared >= least * (len(both) - shared) - 1e-9


def deduplicate(docs: DataFrame, least: float = 0.8, words: int = 5, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of exact and near copies: the one with the least id (a null id after all others).

    Near copies have `least` similarity or more on sets of shingles of `words` words (as 64-bit hashes). Groups are
    components of verified links. Golay keys find the pairs within `distance` bits; an exact search by shingles finds the
    others (see near_components). Rows that repeat both id and text are one document and stay or go together; an id that
    repeats with other texts is another document for each. Null texts count as empty ones.
    """
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        common = common_shingles(docs, words, id_col, text_col)
        texts = classes(docs, common, least, words, id_col, text_col)
        whole = reader(docs, texts, id_col, text_col)
        found = near_components(texts, comparer(texts, whole, words, least), refiner(texts, whole, common, words, least), least, distance)
        grouped = checked_join(texts.select("node", "h", "c", "least", "n"), found, "node", "left").where("n > 1 or component is not null")
        grouped = save(grouped.select("node", "h", "c", "least", F.coalesce("component", "node").alias("component")), "dedup_grouped")
        order = F.struct(F.col("least").isNull(), "least", "node")
        kept = grouped.groupBy("component").agg(F.min_by("node", order).alias("keep"))
        grouped = grouped.join(kept, "component").select("h", "c", "least", (F.col("keep") == F.col("node")).alias("stays"))
        rows = docs.select(F.col(id_col).alias("id"), *identity(text_col))
        drop = checked_join(rows, save(grouped, "dedup_kept"), ["h", "c"], "inner").where(~F.col("stays") | ~F.col("id").eqNullSafe(F.col("least")))
        drop = save(drop.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("c").alias("_c")).distinct(), "dedup_drop")
    h, c = identity(text_col)
    on = docs[id_col].eqNullSafe(drop["_id"]) & (h == drop["_h"]) & (c == drop["_c"])
    return checked_join(docs, drop, on, "left_anti")


def op6_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
