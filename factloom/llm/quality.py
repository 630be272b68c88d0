"""Document quality by a byte-level convolutional network in numpy.

Learned filters WIDTH bytes wide run over the whole document; their responses
are max-pooled over chunks of 2 * HALF bytes that overlap by half, squashed, and
combined by their mean and their maximum over all chunks into one logit. A
filter is a table of weights by offset and byte, so a convolution is a sum of
table look-ups; the gradient reaches only the positions that won a maximum.

The network learns from at most MAX_ROWS labelled texts a class; of one longer
than TRAIN_CHARS it sees that many characters in a row from a place that its id's
hash chooses. Scoring has no such bound. Ids, languages, sources and labels are
no inputs of a score. The intercept moves from the sample's class shares to
the labels' own, so that scores are probabilities.

Defined results: null texts are empty, and empty texts get the score that bare
padding gets; without labels of both classes all scores are the share of label 1
(0.5 if there is none); equal texts score alike. A row without id is neither
trained on nor held out (held_out is null), and is scored like any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import map_texts, pieces, trim

WIDTH = 6
FILTERS = 24
HALF = 64
MAX_ROWS = 1500
TRAIN_CHARS = 16_384
EPOCHS = 10
BATCH = 32
RATE = 0.01
STRIP = 512  # halves convolved at a time


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text divisible by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each closed by WIDTH - 1 zero bytes or more up to a whole half; and the halves of each."""
    halves = [-(-(len(t) + WIDTH - 1) // HALF) for t in texts]
    flat = b"".join(t.ljust(h * HALF, b"\0") for t, h in zip(texts, halves))
    return np.frombuffer(flat + bytes(WIDTH - 1), np.uint8), np.array(halves, np.int64)


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.table = (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.15).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.zeros(2 * FILTERS, np.float32)
        self.base = np.zeros(1, np.float32)
        self.constant: float | None = None

    def responses(self, flat: np.ndarray, halves: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each half's greatest response of each filter, and if asked the position of each. Windows that would reach into
        the next text have no response."""
        count = int(halves.sum())
        last = np.zeros(count, bool)
        last[np.cumsum(halves) - 1] = True
        best = np.empty((count, FILTERS), np.float32)
        at = np.empty((count, FILTERS), np.int64) if where else None
        for a in range(0, count, STRIP):
            b = min(count, a + STRIP)
            n = (b - a) * HALF
            got = self.table[0][flat[a * HALF : a * HALF + n]]
            for j in range(1, WIDTH):
                got += self.table[j][flat[a * HALF + j : a * HALF + j + n]]
            got = got.reshape(b - a, HALF, FILTERS)
            got[last[a:b], HALF - WIDTH + 1 :] = -1e9
            if where:
                top = got.argmax(axis=1)
                best[a:b] = np.take_along_axis(got, top[:, None, :], axis=1)[:, 0]
                at[a:b] = top + (np.arange(a, b) * HALF)[:, None]
            else:
                got.max(axis=1, out=best[a:b])
        return best, at

    def pooled(self, best: np.ndarray, halves: np.ndarray):
        """Chunks (each half with its successor in the document), their documents' mean and maximum features."""
        last = np.cumsum(halves) - 1
        follow = np.arange(1, len(best) + 1)
        follow[last] = last
        chunk = np.maximum(best, best[follow])
        squashed = np.tanh(chunk + self.bias)
        begins = last - halves + 1
        mean = np.add.reduceat(squashed, begins, axis=0, dtype=np.float64) / halves[:, None]
        high = np.maximum.reduceat(squashed, begins, axis=0)
        return follow, squashed, np.concatenate([mean, high], axis=1)

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        flat, halves = laid_out([t.encode() for t in texts])
        best, _ = self.responses(flat, halves)
        _, _, features = self.pooled(best, halves)
        return np.round(1 / (1 + np.exp(-np.clip(features @ self.out.astype(np.float64) + self.base[0], -30, 30))), 6)

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        params = [self.table, self.bias, self.out, self.base]
        first = [np.zeros_like(p) for p in params]
        second = [np.zeros_like(p) for p in params]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                grads = self._gradients([texts[i] for i in rows], labels[rows])
                step += 1
                rate = RATE * (1 - 0.9 * epoch / epochs)
                for p, g, m, v in zip(params, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, texts: list[bytes], labels: np.ndarray):
        flat, halves = laid_out(texts)
        best, at = self.responses(flat, halves, where=True)
        follow, squashed, features = self.pooled(best, halves)
        p = 1 / (1 + np.exp(-np.clip(features @ self.out + self.base[0], -30, 30)))
        slope = ((p - labels) / len(labels)).astype(np.float32)
        owner = np.repeat(np.arange(len(halves)), halves)
        mean_part, high_part = self.out[:FILTERS], self.out[FILTERS:]
        down = (slope / halves).astype(np.float32)[owner][:, None] * mean_part
        wins = squashed == features[:, FILTERS:][owner]
        down = (down + wins * (slope[owner][:, None] * high_part)) * (1 - squashed**2)
        source = np.where(best >= best[follow], at, at[follow])
        table = np.zeros((WIDTH, 256 * FILTERS), np.float32)
        column = np.broadcast_to(np.arange(FILTERS), source.shape)
        for j in range(WIDTH):
            cell = flat[source + j].astype(np.int64) * FILTERS + column
            table[j] = np.bincount(cell.ravel(), down.ravel(), 256 * FILTERS)
        decay = 1e-4
        return table.reshape(self.table.shape) + decay * self.table, down.sum(axis=0), (slope @ features).astype(np.float32) + decay * self.out, np.array([slope.sum()], np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Network:
    """Fit to at most max_rows texts of each class among the rows that are not held out."""
    known = labels.where(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("key"), F.col(label_col).cast("int").alias("label"))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    net = Network()
    if len(share) < 2:
        net.constant = 0.5 if not share else float(next(iter(share)))
        return net
    text, place = F.col(text_col).cast("string"), F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.length(text_col) - TRAIN_CHARS + 1)
    part = F.when(F.length(text) <= TRAIN_CHARS, text).otherwise(F.substr(text, place.cast("int") + 1, F.lit(TRAIN_CHARS)))
    seen = docs.where(text.isNotNull()).select(F.col(id_col).alias("key"), part.alias("text"))
    rows = []
    for label in (0, 1):
        # Some ids may have no text, so more are drawn than used.
        drawn = F.broadcast(known.where(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(2 * max_rows))
        rows += seen.join(drawn, "key").orderBy(F.xxhash64("key"), "text").limit(max_rows).select("text", "label").collect()
    if len({r["label"] for r in rows}) < 2:
        net.constant = share[1] / (share[0] + share[1])
        return net
    y = np.array([r["label"] for r in rows], np.float32)
    net.fit([r["text"].encode() for r in rows], y)
    net.base += np.float32(math.log(share[1] / share[0]) - math.log(y.sum() / (len(y) - y.sum())))
    return net


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, and score, the probability of label 1."""

    def make():
        return lambda _, texts: [pa.array(net.score(texts), pa.float64())]

    return map_texts(docs, id_col, text_col, make, "score double")


def without_rejected(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The documents, all columns, whose score is at least ``least``."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, at):
                scores = net.score([t or "" for t in piece.column(at).to_pylist()])
                yield piece.filter(pa.array(scores >= least))
        trim()

    return docs.mapInArrow(run, docs.schema)
