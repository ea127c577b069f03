"""Benchmark decontamination by greedy string tiling.

Texts become words (lower case; letters, digits and non-ASCII letters), words become 64-bit hashes, and runs of `least`
words become seeds, all from prefix sums of a polynomial hash (Karp-Rabin). The benchmark's seeds go to every task; they
are few, and a larger benchmark is split into parts of at most `part_words` words that are scanned one after another. A
document and an item that share seeds are tiled only if those seeds could cover enough of the item (an upper bound on
any tiling, so nothing is lost). Tiling then repeatedly marks the longest matches of unmarked words, found by running
Karp-Rabin with falling search length; covered words over the item's words is the coverage. Order does not matter, so
passages cut up and reordered are found too.

Cases: null or empty texts and items have no words and no match; an item with fewer words than a seed must occur as a
whole; repeated words of a document match an item's words once; equal texts give equal rows; a null doc_id or item_id is
carried; an empty table on either side gives an empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked_join, save, slices, small_batches, table

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
INVERSE = pow(BASE, -1, 1 << 64)
MIX = U(0xC2B2AE3D27D4EB4F)
WORD_BYTE = np.array([b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
SPACE = {c: " " for c in [*range(0x80, 0xC0), 0xD7, 0xF7, *range(0x2000, 0x2070), 0x3000, 0x3001, 0x3002, 0xFEFF] if c not in (0xAA, 0xB5, 0xBA)}
FILTER_BITS = 22


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and each text's first word (with the end)."""
    parts = []
    for t in texts:
        s = t.decode().lower()
        parts.append((s if s.isascii() else s.translate(SPACE)).encode())
    data = WORD_BYTE[np.frombuffer(b"\0" + b"\0".join(parts) + b"\0", np.uint8)]
    edge = np.diff((data != 0).view(np.int8))
    begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    sums = np.cumsum(data.astype(U) * powers(BASE, len(data)))
    hashes = (sums[end - 1] - sums[begin - 1]) * powers(INVERSE, len(data))[begin]
    hashes = (hashes ^ (hashes >> U(29))) * MIX
    hashes ^= hashes >> U(32)
    first = np.cumsum([0] + [len(p) + 1 for p in parts])
    return hashes, np.searchsorted(begin, first)


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n].copy()
    for k in range(1, width):
        out *= U(BASE)
        out += words[k : k + n]
    return (out ^ (out >> U(31))) * MIX


def _scan(text: np.ndarray, item: np.ndarray, text_used: np.ndarray, item_used: np.ndarray, s: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, item place, text place) of at least s unmarked words."""
    free = lambda used: np.convolve(used, np.ones(s, np.int64), "valid") == 0
    h_item, h_text = runs(item, s), runs(text, s)
    where: dict[int, list[int]] = {}
    for i in np.flatnonzero(free(item_used)).tolist():
        where.setdefault(int(h_item[i]), []).append(i)
    if not where:
        return []
    out = []
    near = np.flatnonzero(free(text_used) & np.isin(h_text, np.array(list(where), U)))
    for t in near.tolist():
        for i in where[int(h_text[t])]:
            if i and t and item[i - 1] == text[t - 1] and not item_used[i - 1] and not text_used[t - 1]:
                continue
            n = min(len(item) - i, len(text) - t)
            stop = np.flatnonzero((item[i : i + n] != text[t : t + n]) | (item_used[i : i + n] != 0) | (text_used[t : t + n] != 0))
            n = int(stop[0]) if len(stop) else n
            if n >= s:
                out.append((n, i, t))
    return out


def _free(n: int, i: int, t: int, item_used: np.ndarray, text_used: np.ndarray) -> list[tuple[int, int, int]]:
    """The unmarked parts of a match, as matches."""
    edge = np.diff(np.concatenate(([1], (item_used[i : i + n] | text_used[t : t + n]) != 0, [1])).astype(np.int8))
    return [(int(b - a), i + int(a), t + int(a)) for a, b in zip(np.flatnonzero(edge == -1), np.flatnonzero(edge == 1), strict=True)]


def tile(text: np.ndarray, item: np.ndarray, least: int, start: int = 20) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (length, item place, text place) of non-overlapping matches.

    Each tile is the longest match of unmarked words at its time, of equally long ones the first in the item, then in the
    text. Matches wait in a heap by length; one that a tile cut short goes back as its unmarked parts.
    """
    text_used, item_used = np.zeros(len(text), np.int64), np.zeros(len(item), np.int64)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(start, len(item)))
    while len(text) >= least <= len(item):
        found = _scan(text, item, text_used, item_used, s) if s <= min(len(text), len(item)) else []
        longest = max((n for n, _, _ in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        heap = [(-n, i, t) for n, i, t in found]
        heapq.heapify(heap)
        while heap:
            n, i, t = heapq.heappop(heap)
            parts = _free(-n, i, t, item_used, text_used)
            if parts == [(-n, i, t)]:
                item_used[i : i - n] = text_used[t : t - n] = 1
                out.append((-n, i, t))
            else:
                for part in parts:
                    if part[0] >= s:
                        heapq.heappush(heap, (-part[0], *part[1:]))
        if s == least:
            break
        s = max(least, s // 2)
    return out


class Bench:
    """Seeds of a part of the benchmark."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        words, first = word_hashes([(t or "").encode() for _, t in items])
        self.ids = [i for i, _ in items]
        self.words = [words[a:b] for a, b in zip(first, first[1:], strict=False)]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.by_width = {}
        for width in sorted({min(least, n) for n in self.size.tolist() if n}):
            rows = [(h, k, p) for k, w in enumerate(self.words) if min(least, len(w)) == width for p, h in enumerate(runs(w, width).tolist())]
            seeds = np.array([r[0] for r in rows], U)
            order = np.argsort(seeds, kind="stable")
            table_ = np.zeros(1 << FILTER_BITS, bool)
            table_[seeds >> U(64 - FILTER_BITS)] = True
            self.by_width[width] = table_, seeds[order], np.array([r[1] for r in rows], np.int64)[order], np.array([r[2] for r in rows], np.int64)[order]

    def candidates(self, words: np.ndarray, first: np.ndarray, share: float) -> list[tuple[int, int]]:
        """(text, item) whose common seeds could cover the share of the item."""
        out = []
        for width, (table_, seeds, item, place) in self.by_width.items():
            h = runs(words, width)
            at = np.flatnonzero(table_[h >> U(64 - FILTER_BITS)])
            lo, hi = np.searchsorted(seeds, h[at]), np.searchsorted(seeds, h[at], "right")
            at, n, lo = at[hi > lo], (hi - lo)[hi > lo], lo[hi > lo]
            owner = np.searchsorted(first, at, "right") - 1
            inside = at + width <= first[owner + 1]
            at, n, lo, owner = at[inside], n[inside], lo[inside], owner[inside]
            if not len(at):
                continue
            pick = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            most = int(self.size.max()) + 1
            code = np.unique((np.repeat(owner, n) * len(self.ids) + item[pick]) * most + place[pick])
            pair, p = code // most, code % most
            gain = np.full(len(code), width)
            same = pair[1:] == pair[:-1]
            gain[:-1][same] = np.minimum(width, (p[1:] - p[:-1])[same])
            heads = np.flatnonzero(np.concatenate(([True], ~same)))
            cover = np.add.reduceat(gain, heads)
            pair = pair[heads]
            good = cover >= share * self.size[pair % len(self.ids)]
            out += [(int(x) // len(self.ids), int(x) % len(self.ids)) for x in pair[good]]
        return out


def leaks(docs: DataFrame, benchmark: DataFrame, least: int = 5, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_words: int = 2_000_000) -> DataFrame:
    """(id, item id, coverage double, tiles int, matched int, item_words int) of every document covering `share` of an item."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("_item"), F.col(item_text).alias("_text"))
    total = items.agg(F.coalesce(F.sum(F.length("_text")), F.lit(0))).first()[0] // 2
    parts = max(1, -(-total // part_words))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} {item_kind}, coverage double, tiles int, matched int, item_words int"
    out = None
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(parts)) == part).collect()
        bench = Bench(sorted(((r[0], r[1]) for r in rows), key=str), least)

        def run(batches: Iterator[pa.RecordBatch], bench: Bench = bench) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece, texts in slices(batch, text_col, 2 << 20):
                    words, first = word_hashes([t or b"" for t in texts])
                    ids, rows = piece.column(0), []
                    for d, k in sorted(bench.candidates(words, first, share)):
                        found = tile(words[first[d] : first[d + 1]], bench.words[k], min(least, len(bench.words[k])))
                        n, size = sum(x[0] for x in found), len(bench.words[k])
                        if n >= share * size:
                            rows.append((ids[d].as_py(), bench.ids[k], round(n / size, 6), len(found), n, size))
                    if rows:
                        kinds = (ids.type, None, pa.float64(), pa.int32(), pa.int32(), pa.int32())
                        names = [id_col, item_col, "coverage", "tiles", "matched", "item_words"]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        found = docs.select(id_col, text_col).mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """docs without those that cover the share of an item; rows go by their texts (two checksums), so ids may repeat or be null."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h, c = F.xxhash64(text), F.crc32(text.cast("binary"))
    found = leaks(docs.select(F.struct(h.alias("h"), c.alias("c")).alias("_doc"), text_col), benchmark, id_col="_doc", text_col=text_col, **options)
    bad = save(found.select("_doc.h", "_doc.c").distinct().toDF("_h", "_c"), "leaks")
    return checked_join(docs, bad, (h == bad["_h"]) & (c == bad["_c"]), "left_anti")


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
