"""Token ids as Parquet list columns.

Documents are range-partitioned and sorted by id (equal ids by their text's checksum), encoded with the tokenizers library
and written as `doc_id, n_tokens, ids: list<int>` with controlled row groups and pages. Ids are dictionary-encoded (a
vocabulary page, then narrow indices), doc_id and n_tokens delta-encoded (Parquet v2 pages); the writer adds page indexes,
so a reader can fetch the metadata columns alone, or the pages of a doc_id range (`read_range`). Files are in doc_id order,
so a document's start is the sum over earlier files plus a running sum inside its file.

Encoding goes by chunks: a run of white space with the word behind it. The byte-level pattern never lets a piece reach
from a word into white space, nor from letters into a punctuation mark other than an apostrophe, so a text's ids are
those of its chunks in a row. Chunks are found in numpy for a slice of texts at once. A chunk of up to 16 bytes is its
length and its first and last eight bytes, which are looked up in a table of chunks that the library has encoded; longer
ones go by a dictionary. Both are bounded. Texts with white space outside ASCII are encoded whole.

Cases: null or empty text has the end id alone; rows that repeat an id are ordered by their text's checksum; the strings of
special tokens are ordinary text; null doc_ids come first; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checked_join, shared_path, slices, small_batches, table

END = 2
SPECIAL = "<|endoftext|>"
# UTF-8 of the white space outside ASCII, and the ASCII separators that count as white space.
WIDE_SPACE = re.compile("[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80".encode("latin-1"))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
ENDS_WORD = np.zeros(256, bool)
ENDS_WORD[list(b",.!?;:")] = True
#: Slots of the table of short chunks (24 bytes and a reference each) and entries of the dictionary of long ones.
SLOTS_BITS, LONG_CHUNKS = 21, 200_000
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1] * 9, np.uint64)
LAYOUT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": str(32 << 20), "parquet.page.size": str(1 << 20), "parquet.page.row.count.limit": "2000"}


def chunk_starts(data: np.ndarray) -> np.ndarray:
    """Where chunks start in bytes that begin and end with a line feed: before white space that follows a word, and before
    the punctuation mark that follows a word's letters."""
    space = SPACE[data]
    edge = np.diff(space.view(np.int8))
    word, after = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    wide = data == 0xC3
    tail = np.zeros(len(data), bool)
    tail[1:] = wide[:-1] & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter = ASCII_LETTER[data] | tail
    letter[:-1] |= tail[1:]
    other = np.flatnonzero(~letter)
    first = other[np.searchsorted(other, word)]
    cut = first[(first > word) & ENDS_WORD[data[first]]]
    starts = np.concatenate((after[:-1], cut))
    starts.sort(kind="stable")
    return starts


class Encoder:
    """Ids of texts as little-endian uint32."""

    def __init__(self, path: str):
        import tokenizers

        self.plain = tokenizers.Tokenizer.from_file(path)
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.mark = self.plain.token_to_id(SPECIAL)
        self.clear()

    def clear(self) -> None:
        n = 1 << SLOTS_BITS
        self.first, self.last = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.length, self.at, self.count = np.zeros(n, np.int8), np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def encode_all(self, chunks: list[bytes], group: int = 256) -> list[np.ndarray]:
        """Ids of each chunk by the library; many go in one call, with a special token between them."""
        out = []
        for at in range(0, len(chunks), group):
            part = [c.decode() for c in chunks[at : at + group]]
            if any("<|" in c for c in part):
                out += [self.one(c) for c in part]
                continue
            ids = np.array(self.plain.encode_batch_fast([SPECIAL.join(part)], add_special_tokens=False)[0].ids, np.uint32)
            found = np.split(ids, np.flatnonzero(ids == self.mark))
            out += [x[k > 0 :] for k, x in enumerate(found)]
        return out

    def one(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def store(self, found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places and lengths of ids put into the pool."""
        size = np.array([len(x) for x in found], np.int32)
        need = self.used + int(size.sum())
        if need > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(need - len(self.pool), len(self.pool)), np.uint32)))
        at = (self.used + np.cumsum(size) - size).astype(np.int32)
        if len(found):
            self.pool[self.used : need] = np.concatenate(found)
        self.used = need
        return at, size

    def look_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of every chunk; eight bytes lie before and behind `data`'s chunks."""
        if self.held > 3 << (SLOTS_BITS - 2) or len(self.long) > LONG_CHUNKS:
            self.clear()
        size = ends - starts
        at, count = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
        words = np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), (len(data) - 7,), (1,))
        short = np.flatnonzero(size <= 16)
        n = size[short]
        first = words[starts[short]] & MASKS[n]
        last = np.where(n > 8, words[ends[short] - 8], np.uint64(0))
        mixed = (first ^ (last * np.uint64(0x9E3779B97F4A7C15)) ^ n.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        slot = ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64)
        todo = np.arange(len(short))
        for _ in range(64):  # linear probing; what finds a free slot is new
            s = slot[todo]
            here = (self.first[s] == first[todo]) & (self.last[s] == last[todo]) & (self.length[s] == n[todo])
            hit = todo[here]
            at[short[hit]], count[short[hit]] = self.at[slot[hit]], self.count[slot[hit]]
            todo = todo[~here]
            if not len(todo):
                break
            free = self.length[slot[todo]] == 0
            new = todo[free]
            if len(new):
                taken, one = np.unique(slot[new], return_index=True)
                one = new[one]  # one chunk a free slot; others with that slot look again
                where, got = self.store(self.encode_all([data[a:b].tobytes() for a, b in zip(starts[short[one]].tolist(), ends[short[one]].tolist(), strict=True)]))
                self.first[taken], self.last[taken], self.length[taken] = first[one], last[one], n[one]
                self.at[taken], self.count[taken] = where, got
                self.held += len(taken)
            slot[todo[~free]] = (slot[todo[~free]] + 1) & ((1 << SLOTS_BITS) - 1)
        if len(todo):
            at[short[todo]], count[short[todo]] = self.by_name(data, starts[short[todo]], ends[short[todo]])
        long = np.flatnonzero(size > 16)
        if len(long):
            at[long], count[long] = self.by_name(data, starts[long], ends[long])
        return at, count

    def by_name(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
        chunks = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        new = [c for c in dict.fromkeys(chunks) if c not in self.long]
        where, got = self.store(self.encode_all(new, 64))
        self.long.update(zip(new, zip(where.tolist(), got.tolist(), strict=True), strict=True))
        found = [self.long[c] for c in chunks]
        return [x for x, _ in found], [x for _, x in found]

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, `end` behind each text, and where each text's ids begin (with the end)."""
        wide = [k for k, t in enumerate(texts) if WIDE_SPACE.search(t)]
        apart = set(wide)
        plain = [b"" if k in apart else t for k, t in enumerate(texts)]
        # a line feed and a letter between texts: the letter ends the one's last white space, and neither is read as a chunk
        begin = np.cumsum([9] + [len(t) + 2 for t in plain])[:-1]
        data = np.frombuffer(b"       \nx" + b"\nx".join(plain) + b"\nx\n       ", np.uint8)
        starts = self.borders(data, begin, np.array([len(t) for t in plain]))
        owner = np.searchsorted(begin, starts[0], "right") - 1
        at, count = self.look_up(data, *starts)
        per_text = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        odd = {k: self.one(texts[k].decode()) for k in wide}
        for k, ids in odd.items():
            per_text[k] = len(ids)
        edge = np.concatenate(([0], np.cumsum(per_text + 1)))
        out = np.full(edge[-1], end, np.uint32)
        held = np.concatenate(([0], np.cumsum(count)))
        first = np.concatenate(([0], np.cumsum(np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64))))
        put = held[:-1] + (edge[:-1] - first[:-1])[owner]  # where each chunk's ids go
        step = np.arange(held[-1])
        out[np.repeat(put - held[:-1], count) + step] = self.pool[np.repeat(at - held[:-1], count) + step]
        for k, ids in odd.items():
            out[edge[k] : edge[k] + len(ids)] = ids
        return out, edge

    @staticmethod
    def borders(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the chunks of every text."""
        full = size > 0
        inner = chunk_starts(data)
        stop = begin + size
        owner = np.searchsorted(begin, inner, "right") - 1
        ok = (owner >= 0) & (inner > begin[owner]) & (inner < stop[owner])
        starts = np.concatenate((begin[full], inner[ok]))
        starts.sort(kind="stable")
        ends = np.empty_like(starts)
        ends[:-1] = starts[1:]
        last = np.searchsorted(starts, stop[full], "left") - 1
        ends[last] = stop[full]
        return starts, ends


def encoder(path: str) -> Encoder:
    """One encoder a worker process, held by the library's module so that it outlives a task."""
    import tokenizers

    held = tokenizers.__dict__.setdefault("_chunk_encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]


def encoded(docs: DataFrame, path: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens int, ids array<int>) of every whole text, the end id appended."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part, texts in slices(batch, text_col, 1 << 20):
                values, edge = own.encode([t or b"" for t in texts], end)
                ids = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(values.view(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(edge).astype(np.int32)), ids], [id_col, "n_tokens", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_tokens int, ids array<int>")


def write_tokens(docs: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", rows_a_file: int = 20_000, **layout: str) -> None:
    """Write the token files to `out`, in ascending id order; rows that share an id are dealt by their text's checksum, equal rows too."""
    files = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // rows_a_file))
    keyed = docs.select(id_col, text_col, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_check"), F.monotonically_increasing_id().alias("_tie"))
    ranged = keyed.repartitionByRange(files, id_col, "_check", "_tie").sortWithinPartitions(id_col, "_check", "_tie")
    encoded(ranged, path, id_col=id_col, text_col=text_col).write.options(**(LAYOUT | layout)).parquet(out)


def read_range(spark: SparkSession, out: str, low: int, high: int, columns: tuple[str, ...] = ("doc_id", "n_tokens"), id_col: str = "doc_id") -> DataFrame:
    """Selective read: the named columns of ids low..high; other files, row groups and pages are skipped by their statistics."""
    return spark.read.parquet(out).where(F.col(id_col).between(low, high)).select(*columns)


def read_tokens(spark: SparkSession, out: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start long, n_tokens long, ids_crc32 long) as the files say."""
    files = spark.read.parquet(out)
    kind = files.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(1)
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy().tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64()), batch.column(2), batch.column(3)], [id_col, "n_tokens", "ids_crc32", "file", "place"])

    own = F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place")
    rows = files.select(id_col, "ids", *own).mapInArrow(run, f"{id_col} {kind}, n_tokens long, ids_crc32 long, file string, place long")
    # offsets of the files from the metadata columns alone
    sums = files.select("n_tokens", own[0]).groupBy("file").agg(F.sum("n_tokens").cast("long").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run_sum = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = checked_join(rows.withColumn("_at", run_sum), sums.select("file", "_before"), "file", "inner")
    return placed.select(id_col, (F.col("_before") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, out)
