"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is lower-cased; ASCII letters and all bytes of other characters stay and all else becomes a space. Every 2-, 3- and
4-byte window of a text (none reaches into its neighbour) hashes to one of 2^17 embeddings; their mean goes through a linear softmax. Embeddings and softmax are trained by stochastic
gradient descent in numpy on a bounded sample (`each` documents a language of at most `most_bytes` bytes). A fifth of the
sample calibrates: a temperature that minimises its log loss, and the least score above which at most `errors` of its
rows are wrong; rows below are marked not accepted, the best language is still named. As mean and softmax are linear up
to the end, embeddings are multiplied by the softmax weights once, and a text's logits are means of table rows.

Cases: null text or one without a letter (Unicode category L) is `und` with score 0; whole texts count, in pieces if very
long; equal texts get equal answers, whatever stands beside them; without any labelled row all are `und`; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drawn, excerpt, fold, slices, small_batches, table

BUCKETS = 1 << 17
ASCII_LETTER, LETTER = re.compile("[A-Za-z]"), regex.compile(r"\p{L}")
KEEP = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
PIECE = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(ASCII_LETTER.search(text) or LETTER.search(text))


def stream(text: str) -> bytes:
    return b" " + text.lower().encode().translate(KEEP) + b"   "


def windows(data: np.ndarray) -> list[np.ndarray]:
    """Bucket of the 2-, 3- and 4-byte window at each place but the last three."""
    b = data.astype(np.uint32)
    h2 = b[:-3] * np.uint32(0x9E3779B1) + b[1:-2] * np.uint32(0x85EBCA77)
    h3 = h2 * np.uint32(0x2545F491) + b[2:-1] * np.uint32(0xC2B2AE3D)
    h4 = h3 * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
    return [(h ^ h >> np.uint32(15)) >> np.uint32(0) & np.uint32(BUCKETS - 1) for h in (h2, h3, h4)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    def __init__(self, langs: list[str], rows: np.ndarray, bias: np.ndarray, heat: float, accept: float):
        self.langs, self.rows, self.bias, self.heat, self.accept = langs, rows, bias, heat, accept

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out: list[tuple[str, float, bool]] = [("und", 0.0, False)] * len(texts)
        todo = [(i, stream(t)) for i, t in enumerate(texts) if self.langs and has_letter(t)]
        logits = np.zeros((len(texts), len(self.langs)))
        size = np.zeros(len(texts))
        at = 0
        while at < len(todo):  # texts together up to PIECE bytes; a longer one in overlapping pieces
            group, total = [], 0
            while at < len(todo) and (not group or total + len(todo[at][1]) <= PIECE):
                group.append(todo[at])
                total += len(todo[at][1])
                at += 1
            data = np.frombuffer(b"".join(s for _, s in group), np.uint8)
            starts = np.cumsum([0] + [len(s) for _, s in group])
            for lo in range(0, len(data) - 3, PIECE):
                part = data[lo : lo + PIECE + 3]
                h2, h3, h4 = windows(part)
                value = self.rows[h2]
                value += self.rows[h3]
                value += self.rows[h4]
                for back in (1, 2, 3):  # windows that begin here would reach beyond their text
                    last = starts[1:] - back - lo
                    value[last[(last >= 0) & (last < len(value))]] = 0
                inside = np.flatnonzero((starts[:-1] < lo + len(value)) & (starts[1:] > lo))
                sums = np.add.reduceat(value, np.maximum(starts[inside] - lo, 0), axis=0, dtype=np.float64)
                for j, s in zip(inside, sums, strict=True):
                    logits[group[j][0]] += s
            for i, s in group:
                size[i] = 3.0 * (len(s) - 3)
        for i, _ in todo:
            p = softmax((logits[i] / size[i] + self.bias) / self.heat)
            k = int(p.argmax())
            out[i] = (self.langs[k], round(float(p[k]), 6), bool(p[k] >= self.accept))
        return out


def train(samples: list[tuple[str, str]], dim: int = 16, epochs: int = 4, rate: float = 4.0, errors: float = 0.01, seed: int = 5) -> Model:
    """samples: (text, lang)."""
    samples = [(t, lang) for t, lang in samples if has_letter(t)]
    langs = sorted({lang for _, lang in samples})
    if not samples:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for text, lang in samples:
        found, n = np.unique(np.concatenate(windows(np.frombuffer(stream(text), np.uint8))), return_counts=True)
        bags.append((found, (n / n.sum()).astype(np.float32), langs.index(lang)))
    order = rng.permutation(len(bags))
    held = [bags[i] for i in order[: len(bags) // 5]] if len(bags) >= 10 * len(langs) else bags
    own = [bags[i] for i in order[len(bags) // 5 :]] if len(bags) >= 10 * len(langs) else bags
    emb = rng.normal(0, 0.1, (BUCKETS, dim)).astype(np.float32)
    out, bias = rng.normal(0, 0.3, (dim, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    steps, step = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(len(own)):
            found, share, k = own[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = share @ emb[found]
            g = softmax(mean @ out + bias)
            g[k] -= 1
            back = out @ g
            out -= 0.1 * lr * np.outer(mean, g)
            bias -= 0.01 * lr * g
            emb[found] -= (lr * 10) * share[:, None] * back[None, :]
    rows = emb @ out
    z = np.array([share @ rows[found] + bias for found, share, _ in held], np.float64)
    k = np.array([x[2] for x in held])
    heats = np.geomspace(0.05, 20, 60)
    # labels smoothed by what so many rows can tell, or a sample without errors would ask for certainty
    smooth = np.full(z.shape, 1 / ((len(k) + 2) * max(1, len(langs) - 1)))
    smooth[np.arange(len(k)), k] = 1 - 1 / (len(k) + 2)
    loss = [-(smooth * np.log(np.maximum(softmax(z / h), 1e-12))).sum(axis=1).mean() for h in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / heat)
    best, good = p.max(axis=1), p.argmax(axis=1) == k
    down = np.argsort(-best, kind="stable")
    right = np.flatnonzero(np.cumsum(~good[down]) <= errors * np.arange(1, len(k) + 1))
    accept = float(best[down[right[-1]]]) if len(right) else 1.0
    return Model(langs, rows.astype(np.float32), bias.astype(np.float64), heat, min(accept, 0.999))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = 500, most_bytes: int = 20_000, **options) -> Model:
    """Train on a sample of about `each` rows a language; of a text over `most_bytes` bytes, windows spread over it."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col)
    got = drawn(rows, lang_col, [id_col, text_col], each).select(excerpt(F.col(text_col), most_bytes), lang_col).collect()
    return train([(r[0], r[1]) for r in got], **options)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every whole text."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col):
                lang, score, ok = zip(*model.predict([t if t is None else t.decode() for t in texts]), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ok, pa.bool_())], [id_col, "lang_pred", "score", "accepted"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, accepted boolean")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")
