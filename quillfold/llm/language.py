"""Language identification by a convolutional network over bytes.

Texts are cut into fixed-length byte windows. Each byte has a small embedding; filters of several widths slide over the
window, each keeps its maximum, and a softmax layer names the language. A text's prediction is the mean of its windows'
probabilities over the whole text. Training is plain numpy on the driver, on at most `train_docs` labelled documents
chosen by a hash of their id (equal shares for each language); prediction is one pass without any shuffle.

Null and empty texts and texts without a letter are `und` with score 0. Rows are judged one by one, so repeated rows agree.
With no labelled training row every text is `und`; an empty table gives no rows. Texts of any length are judged whole, some
windows at a time. predict() hands on the columns that the caller names, such as a struct of them all, and ignores others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as c

LETTER = re.compile(r"[^\W\d_]")
LENGTH, WIDTHS, FILTERS, EMBED = 192, (2, 3, 4), 12, 8
#: Bound of the labelled sample and of the windows taken from each of its documents.
TRAIN_DOCS, WINDOWS_PER_DOC = 3200, 4


def held_out(mod: int, left: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == left, F.lit(False))


def windows_of(data: bytes, length: int = LENGTH) -> np.ndarray:
    """(n, length) bytes; the text is padded with zeros, and the first bytes of a window repeat the last of the one before."""
    step = length - max(WIDTHS) + 1
    n = max(1, -(-(len(data) - length) // step) + 1)
    padded = np.zeros((n - 1) * step + length, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, length), (step, 1))


@dataclass
class ByteConvNet:
    """Weights: embedding (256, e), filters (max width * e, widths * filters), their biases, dense layer and its biases."""

    labels: list[str]
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    mask: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], seed: int) -> ByteConvNet:
        r, span, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
        mask = np.zeros((span, EMBED, n), np.float32)
        for k, width in enumerate(WIDTHS):
            mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        mask = mask.reshape(span * EMBED, n)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        return cls(labels, f(256, EMBED, scale=0.5), f(span * EMBED, n, scale=0.25) * mask, np.zeros(n, np.float32), f(n, len(labels), scale=0.2), np.zeros(len(labels), np.float32), mask)

    def patches(self, x: np.ndarray) -> np.ndarray:
        """(rows, positions, span * e): the embedded bytes under the widest filter at each position."""
        e = self.embed[x]
        span, n = max(WIDTHS), x.shape[1] - max(WIDTHS) + 1
        return np.lib.stride_tricks.as_strided(e, (len(x), n, span * EMBED), (e.strides[0], e.strides[1], e.strides[2]))

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maps = self.patches(x) @ self.conv
        return maps, np.maximum(maps.max(1) + self.conv_bias, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.hidden(x)[1] @ self.dense + self.dense_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        patches = self.patches(x)
        maps = patches @ self.conv
        best = maps.argmax(1)
        top = np.take_along_axis(maps, best[:, None], 1)[:, 0] + self.conv_bias
        h = np.maximum(top, 0)
        z = h @ self.dense + self.dense_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (top > 0)
        chosen = patches[np.arange(len(x))[:, None], best]  # rows, filters, span * e
        conv = np.einsum("bf,bfk->kf", back, chosen) * self.mask
        to_patch = back[:, :, None] * self.conv.T[None]
        embed = np.zeros_like(self.embed)
        span = max(WIDTHS)
        at = np.take_along_axis(x, (best[:, :, None] + np.arange(span)).reshape(len(x), -1), 1)
        np.add.at(embed, at.reshape(-1), to_patch.reshape(-1, EMBED))
        return embed, conv, back.sum(0), h.T @ p, p.sum(0)


def train(x: np.ndarray, y: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.004, seed: int = 1) -> ByteConvNet:
    """Adam on the cross-entropy of single windows."""
    net, r = ByteConvNet.fresh(labels, seed), np.random.default_rng(seed)
    weights = [net.embed, net.conv, net.conv_bias, net.dense, net.dense_bias]
    m, v, t = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        for k in range(0, len(x), batch):
            part = order[k : k + batch]
            t += 1
            for w, g, a, b in zip(weights, net.gradients(x[part], y[part]), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (1 - epoch / epochs) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-7)
    return net


def sample(docs: DataFrame, most: int) -> DataFrame:
    """Ids of labelled rows with text, as even over the languages as there are rows, chosen by hash: at most `most`, or one
    for each language if there are more languages than that. One scan, whose tasks cut the ranks before they shuffle."""
    rows = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= most)
    # by rank, so every language has its first row before any has its second
    kept = ranked.select("rank", "doc_id").orderBy("rank", "lang").limit(most).collect()
    if kept and kept[-1]["rank"] == 1:  # as many languages as rows, or more
        kept = ranked.where("rank = 1").select("rank", "doc_id").collect()
    return docs.sparkSession.createDataFrame(sorted({(r.doc_id,) for r in kept}), "doc_id long")


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 1) -> ByteConvNet | None:
    """The network learned from docs' text and lang; None without labelled rows."""
    chosen = docs.where("lang IS NOT NULL").join(F.broadcast(sample(docs, train_docs)), "doc_id").select("doc_id", "text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text, lang in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if text and LETTER.search(text):
                    w = windows_of(text.encode("utf-8", "surrogatepass"))
                    r = np.random.default_rng([seed, abs(doc)])
                    out += [(doc, lang, w[i].tobytes()) for i in sorted(r.choice(len(w), min(len(w), WINDOWS_PER_DOC), replace=False))]
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "lang", "x"), row, strict=True)) for row in out], schema=pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("x", pa.binary())]))

    rows = sorted(tuple(r) for r in chosen.mapInArrow(c.released(cut), "doc_id long, lang string, x binary").collect())
    if not rows:
        return None
    labels = sorted({r[1] for r in rows})
    return train(np.array([np.frombuffer(r[2], np.uint8) for r in rows]), np.array([labels.index(r[1]) for r in rows]), labels, seed=seed)


def predict(docs: DataFrame, net: ByteConvNet | None, columns: tuple[str, ...] = ("doc_id",), batch: int = 1024) -> DataFrame:
    """The named columns with lang_pred and score."""
    kept = docs.select(*columns, "text")

    def texts(column: pa.Array) -> tuple[list, list]:
        names, scores, open_, held = ["und"] * len(column), [0.0] * len(column), [], 0
        if net is None:
            return names, scores
        total = np.zeros((len(column), len(net.labels)))

        def flush():
            x = np.concatenate([w for _, w in open_])
            p = net.probabilities(x)
            np.add.at(total, np.concatenate([np.full(len(w), i) for i, w in open_]), p)

        for i, text in enumerate(column):
            text = text.as_py()
            if text and LETTER.search(text):
                w = windows_of(text.encode("utf-8", "surrogatepass"))
                for k in range(0, len(w), batch):
                    open_.append((i, w[k : k + batch]))
                    held += len(open_[-1][1])
                    if held >= batch:
                        flush()
                        open_, held = [], 0
        if open_:
            flush()
        for i, row in enumerate(total):
            if row.sum() > 0:
                names[i], scores[i] = net.labels[int(row.argmax())], float(min(1.0, row.max() / row.sum()))
        return names, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, scores = texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in columns), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    schema = kept.select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return kept.mapInArrow(c.released(run), schema)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = c.read(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(4, 2)))
    return predict(docs, net).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
