"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded; filters 8 bytes wide slide over the text in steps of 4. Chunks of 256 bytes overlap by half and cover
the whole document; each filter's greatest response in a chunk (after a rectifier) is the chunk's feature. A document's
mean and greatest chunk features go through a small dense layer to one probability. All weights are learned by
back-propagation (Adam) on a bounded sample (about `each` labelled documents a class, of a text over `most_bytes` bytes
windows spread evenly over it), and the last bias is moved from the sample's class shares to those of all labelled rows.

Cases: null or empty text is scored as one chunk of zero bytes; a very long text is convolved in sections; equal texts
get equal scores; without labelled rows of both classes every score is the share of label 1 (0.5 without any); labels
with null id or value are left out, several labels of a document count as their least; an empty table gives an empty
result; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import drawn, excerpt, fold, slices, small_batches, table

STEP, DIM, FILTERS, HIDDEN = 4, 8, 32, 16
PAIR = 128  # bytes of half a chunk
WINDOWS = PAIR // STEP
SECTION = PAIR * 4096
LEAST_SCORE = 0.3


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts padded with zero bytes to whole halves, and the first half of each (with the end).

    A step of zeros stands before and behind each text, so that no window sees its neighbour.
    """
    halves = [(len(t) + 2 * STEP - 1) // PAIR + 1 for t in texts]
    data = b"".join((b"\0" * STEP + t).ljust(n * PAIR, b"\0") for t, n in zip(texts, halves, strict=True))
    return np.frombuffer(data + b"\0" * STEP, np.uint8), np.cumsum([0, *halves])


class Net:
    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = np.float32
        k = STEP * DIM
        self.w = {
            "emb": r.normal(0, 0.5, (256, DIM)).astype(f), "a": r.normal(0, 1 / math.sqrt(2 * k), (k, FILTERS)).astype(f), "b": r.normal(0, 1 / math.sqrt(2 * k), (k, FILTERS)).astype(f), "c": np.zeros(FILTERS, f),
            "h": r.normal(0, 1 / math.sqrt(2 * FILTERS), (2 * FILTERS, HIDDEN)).astype(f), "hb": np.zeros(HIDDEN, f), "o": r.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN).astype(f), "ob": np.zeros(1, f),
        }
        self.shift, self.flat = 0.0, None  # shift: class shares; flat: the only answer if nothing could be learned

    def _conv(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.w["emb"][data].reshape(-1, STEP * DIM)
        z = x[:-1] @ self.w["a"]
        z += x[1:] @ self.w["b"]
        return x, z.reshape(-1, WINDOWS, FILTERS)

    def _top(self, pooled: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunk features, which half each came from, and the documents' vectors."""
        later = np.vstack([pooled[1:], pooled[-1:]])
        later[starts[1:] - 1] = -np.inf  # a document's last half is a chunk of its own
        from_later = later > pooled
        chunk = np.maximum(np.where(from_later, later, pooled) + self.w["c"], 0)
        n = np.diff(starts)[:, None]
        doc = np.hstack([np.add.reduceat(chunk, starts[:-1], axis=0) / n, np.maximum.reduceat(chunk, starts[:-1], axis=0)])
        return chunk, from_later, doc

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.flat is not None:
            return np.full(len(texts), self.flat)
        data, starts = laid(texts)
        pooled = np.vstack([self._conv(data[at : min(at + SECTION, len(data) - STEP) + STEP])[1].max(axis=1) for at in range(0, len(data) - STEP, SECTION)])
        doc = self._top(pooled, starts)[2]
        z = (np.tanh(doc @ self.w["h"] + self.w["hb"]) @ self.w["o"] + self.w["ob"][0]).astype(np.float64) + self.shift
        return np.round(1 / (1 + np.exp(-z)), 6)

    def grads(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        data, starts = laid(texts)
        x, z = self._conv(data)
        where = z.argmax(axis=1)
        pooled = np.take_along_axis(z, where[:, None, :], axis=1)[:, 0]
        chunk, from_later, doc = self._top(pooled, starts)
        hid = np.tanh(doc @ w["h"] + w["hb"])
        p = 1 / (1 + np.exp(-(hid @ w["o"] + w["ob"][0])))
        d = ((p - y) / len(y)).astype(np.float32)
        g = {"o": hid.T @ d, "ob": d.sum(keepdims=True)}
        dh = d[:, None] * w["o"] * (1 - hid * hid)
        g |= {"h": doc.T @ dh, "hb": dh.sum(axis=0)}
        dd = dh @ w["h"].T
        n = np.diff(starts)
        owner = np.repeat(np.arange(len(y)), n)
        top = (chunk == doc[owner, FILTERS:]).astype(np.float32)  # equal greatest chunks share the gradient
        top /= np.add.reduceat(top, starts[:-1], axis=0)[owner]
        dc = dd[owner, :FILTERS] / n[owner, None] + dd[owner, FILTERS:] * top
        dc *= chunk > 0
        g["c"] = dc.sum(axis=0)
        dp = np.where(from_later, 0, dc)
        dp[1:] += np.where(from_later, dc, 0)[:-1]
        at = np.arange(len(where))[:, None] * WINDOWS + where
        g["a"], g["b"] = (np.einsum("pf,pfk->kf", dp, x[at + k]) for k in (0, 1))
        back = np.concatenate([dp[:, :, None] * w["a"].T[None], dp[:, :, None] * w["b"].T[None]], axis=2).reshape(-1, 2 * STEP, DIM)
        byte = data[(at.reshape(-1) * STEP)[:, None] + np.arange(2 * STEP)].reshape(-1)
        back = back.reshape(-1, DIM)
        g["emb"] = np.stack([np.bincount(byte, back[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
        return g


def train(samples: list[tuple[bytes, int]], shares: tuple[float, float] | None = None, epochs: int = 5, rate: float = 0.004, batch: int = 16, seed: int = 3) -> Net:
    """samples: (text, label 0 or 1); shares: of the labels among all labelled rows."""
    net, rng = Net(seed), np.random.default_rng(seed)
    y = np.array([k for _, k in samples], np.float32)
    if len(set(y.tolist())) < 2:
        net.flat = 0.5 if not len(y) else round(float(y.mean()), 6)
        return net
    texts = [t for t, _ in samples]
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    steps, step = epochs * -(-len(texts) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            step += 1
            lr = rate * min(1, step / 20) * (1 - 0.95 * step / steps)
            for k, g in net.grads([texts[i] for i in part], y[part]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                net.w[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    if shares:
        own = float(y.mean())
        net.shift = math.log(shares[1] / shares[0]) - math.log(own / (1 - own))
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", each: int = 700, most_bytes: int = 16_000, **options) -> Net:
    """Train on about `each` labelled documents a class; of a text over `most_bytes` bytes, windows spread over it."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.min(label_col).cast("int").alias("_label"))
    known = known.join(docs.select(id_col).distinct(), id_col, "left_semi")
    count = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    picked = drawn(known, "_label", [id_col], each)  # bounded: 4 * each rows at most
    rows = docs.select(id_col, text_col).join(F.broadcast(picked), id_col)
    rows = rows.select(id_col, "_label", excerpt(F.col(text_col), most_bytes).alias("_text"))
    got = rows.groupBy(id_col, "_label").agg(F.min("_text")).select(id_col, "min(_text)", "_label").collect()  # an id counts once
    got = sorted(((r[0], r[1] or "", r[2]) for r in got), key=str)
    total = sum(count.values()) or 1
    shares = (count.get(0, 0) / total, count.get(1, 0) / total)
    return train([(t.encode(), k) for _, t, k in got], shares if all(shares) else None, **options)


def scores(docs: DataFrame, net: Net, text_col: str = "text") -> DataFrame:
    """docs + score double, of every whole text; a column `score` of docs gives way."""
    docs = docs.drop("score")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text_col, 1 << 20):
                found = net.score([t or b"" for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64())], [*part.schema.names, "score"])

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(run, schema)


def kept(docs: DataFrame, net: Net, least: float = LEAST_SCORE, text_col: str = "text") -> DataFrame:
    """docs that score `least` or more, with their own columns."""
    inner = docs.select(F.col(text_col).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("_doc")) if "score" in docs.columns else docs
    out = scores(inner, net, "text" if "score" in docs.columns else text_col).where(F.col("score") >= least)
    return out.select("_doc.*") if "score" in docs.columns else out.select(*docs.columns)


def op9_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = scores(docs, net)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))
