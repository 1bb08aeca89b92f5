"""A byte-level convolutional network in numpy for document quality.

A document's bytes are cut into overlapping chunks that cover all of it. Learned
filters over windows of bytes slide through every chunk, their responses are
max-pooled within it, and a hidden layer turns them and the chunk's length into its
logit. The chunks' logits, pooled over the document, are combined into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mapped, named

WIDTH, STRIDE, HALF = 8, 2, 256
FILTERS, HIDDEN = 24, 16
#: Bytes convolved at once, so that memory does not follow the length of a text.
BLOCK = 1 << 17


def halves(text: bytes) -> int:
    """How many half-chunks of HALF bytes cover a text and the end of its last window."""
    return (len(text) + WIDTH - 1) // HALF + 1


def pooled_halves(data: np.ndarray, table: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Max of each filter over the windows that start in each half-chunk of data.

    last: half-chunks that end a text; nothing of the next text reaches into them.
    """
    beyond, blank = (WIDTH - 1) // STRIDE, table[:, 0].sum(0)
    n = len(data) // HALF
    out = np.empty((n, table.shape[2]), np.float32)
    data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    step = BLOCK // HALF
    for k in range(0, n, step):
        part = data[k * HALF : min(k + step, n) * HALF + WIDTH]
        size = len(part) - WIDTH
        total = table[0].take(part[0:size:STRIDE], axis=0)
        for j in range(1, WIDTH):
            total += table[j].take(part[j : j + size : STRIDE], axis=0)
        total = total.reshape(size // HALF, HALF // STRIDE, -1)
        # The windows that run over the end hold padding alone.
        total[last[k : k + step], -beyond:] = blank
        out[k : k + step] = total.max(1)
    return out


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts, each padded with zero bytes to whole half-chunks, and their numbers of these."""
    sizes = np.array([halves(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(t.ljust(HALF * int(n), b"\0") for t, n in zip(texts, sizes)), np.uint8), sizes


class Network:
    """The learned parameters, and the probability of texts."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.w1 = (rng.standard_normal((FILTERS + 1, HIDDEN)) / FILTERS**0.5).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = (rng.standard_normal(HIDDEN) / HIDDEN**0.5).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.shift, self.combine = 0.0, np.zeros(5)
        self.prior: float | None = None

    def inputs(self, pooled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The hidden layer's inputs: pooled responses, and how long the chunk is."""
        return np.concatenate([pooled - self.shift, (np.log1p(lengths) - 5)[:, None].astype(np.float32)], 1)

    def chunk_logits(self, pooled: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.tanh(self.inputs(pooled, lengths) @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """For each text: the mean, smallest and largest logit of its chunks, and its length."""
        data, sizes = laid_out(texts)
        ends = np.cumsum(sizes)
        last = np.zeros(len(data) // HALF, bool)
        last[ends - 1] = True
        pooled = pooled_halves(data, self.table, last)
        # A chunk is two half-chunks in a row of one text; a text of one half is a chunk.
        nxt = np.minimum(np.arange(len(pooled)) + 1, len(pooled) - 1)
        nxt[ends - 1] = ends - 1
        begun = np.arange(len(pooled)) - np.repeat(ends - sizes, sizes)
        lengths = np.clip(np.repeat([len(t) for t in texts], sizes) - begun * HALF, 0, 2 * HALF)
        logits = self.chunk_logits(np.maximum(pooled, pooled[nxt]), lengths).astype(np.float64)
        keep = np.ones(len(logits), bool)
        keep[(ends - 1)[sizes > 1]] = False
        logits, counts = logits[keep], np.maximum(sizes - 1, 1)
        starts = np.cumsum(counts) - counts
        return np.stack([
            np.add.reduceat(logits, starts) / counts, np.minimum.reduceat(logits, starts), np.maximum.reduceat(logits, starts),
            np.log1p([len(t) for t in texts]), np.ones(len(texts)),
        ], 1)

    def probability(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.combine, -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, *, epochs=6, batch=256, rate=0.01, seed=7) -> Network:
    """Fits a network on whole texts: on every chunk of each, and on two short pieces of it, as
    few of the texts to learn from are short, but short ones are to be judged as well."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        net.prior = float(labels[0]) if len(labels) else 0.5
        return net
    span = 2 * HALF + WIDTH
    # Chunks are places in one buffer; only a batch of them is laid out at a time.
    starts, sizes, of, begun = [], [], [], 0
    for k, text in enumerate(texts):
        at = np.arange(max(halves(text) - 1, 1)) * HALF
        short = rng.integers(8, 250, 2)
        places = [text.rfind(b" ", 0, int(rng.integers(0, max(1, len(text) - n)))) + 1 for n in short.tolist()]
        at, ends = np.concatenate([at, places]), np.concatenate([at + span, places + short])
        starts.append(begun + at)
        sizes.append(np.minimum(ends, len(text)) - at)
        of.append(np.full(len(at), k))
        begun += len(text)
    starts, sizes, of = np.concatenate(starts), np.maximum(np.concatenate(sizes), 0), np.concatenate(of)
    buffer = np.frombuffer(b"".join(texts) + bytes(span), np.uint8)
    reach = np.arange(span)
    lengths = np.minimum(sizes, 2 * HALF)
    y, share = labels[of].astype(np.float32), np.bincount(of)[of].astype(np.float32)
    weight = 1 / share**0.5
    # Both classes weigh the same to the filters; the last layer is fitted to the true shares.
    for label in (0, 1):
        weight[y == label] /= weight[y == label].sum()
    weight *= len(y) / 2
    moments: dict[str, list] = {}
    step = 0

    def adam(name: str, grad: np.ndarray) -> None:
        value = getattr(net, name)
        m = moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m[0] = 0.9 * m[0] + 0.1 * grad
        m[1] = 0.99 * m[1] + 0.01 * grad**2
        value -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

    windows = 2 * HALF // STRIDE
    for epoch in range(epochs):
        order = rng.permutation(len(starts))
        for k in range(0, len(order), batch):
            step += 1
            rows = order[k : k + batch]
            n = len(rows)
            x = np.where(reach < sizes[rows, None], buffer[starts[rows, None] + reach], 0)  # zero bytes fill up
            total = np.zeros((n, windows, FILTERS), np.float32)
            for j in range(WIDTH):
                total += net.table[j].take(x[:, j : j + 2 * HALF : STRIDE], axis=0)
            best = total.argmax(1)
            pooled = np.take_along_axis(total, best[:, None], 1)[:, 0]
            if step == 1:
                net.shift = float(pooled.mean())
            given = net.inputs(pooled, lengths[rows])
            hidden = np.tanh(given @ net.w1 + net.b1)
            logit = hidden @ net.w2 + net.b2[0]
            d = (1 / (1 + np.exp(-logit)) - y[rows]) * weight[rows] / n
            d_hidden = np.outer(d, net.w2) * (1 - hidden**2)
            d_pooled = d_hidden @ net.w1[:FILTERS].T
            table = np.empty_like(net.table)
            for j in range(WIDTH):
                byte = np.take_along_axis(x, best * STRIDE + j, 1).astype(np.int64)
                table[j] = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), d_pooled.ravel(), 256 * FILTERS).reshape(256, FILTERS)
            grads = {"w1": given.T @ d_hidden, "b1": d_hidden.sum(0), "w2": hidden.T @ d, "b2": d.sum(keepdims=True)}
            for name, grad in (grads | {"table": table}).items():
                adam(name, grad.astype(np.float32))
        rate *= 0.7
    f = np.concatenate([net.features(texts[k : k + 200]) for k in range(0, len(texts), 200)])
    w, ridge = np.zeros(f.shape[1]), np.eye(f.shape[1]) * 1e-2
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        w -= np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + ridge, f.T @ (p - labels) + ridge @ w)
    net.combine = w
    return net


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="quality", most_rows=4000, most_bytes=64_000_000) -> Network:
    """Fits the network on whole texts of at most most_rows labelled rows that are not held out.

    The rows are the first by a hash of their ids; at most half of them are of each
    label where there are enough. They reach the driver as far as their texts come to
    most_bytes together (rows beyond that are not learnt from; none is cut): memory there is
    bounded by the two parameters. A null label or id does not count; of ids with several
    labels the smallest does, of rows that repeat an id the one with the smallest text.
    """
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("of")).agg(F.min(label_col).alias("y"))
    order = F.xxhash64("of", F.lit("sample"))
    chosen = [usable.where(F.col("y") == y).orderBy(order).limit(n) for y, n in ((0, most_rows // 2), (1, most_rows - most_rows // 2))]
    sample = F.broadcast(chosen[0].unionAll(chosen[1]))  # most_rows rows at most
    text = F.coalesce(named(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(named(id_col).alias("id"), text.alias("text")).join(sample, F.col("id") == F.col("of"))
    rows = rows.groupBy("of", "y").agg(F.min("text").alias("text"))
    # most_rows rows at most are ordered here.
    upto = F.sum(F.octet_length("text")).over(Window.orderBy(order, "of"))
    rows = rows.withColumn("upto", upto).where(F.col("upto") <= most_bytes).select("of", "y", "text").toPandas().sort_values("of")
    return train([bytes(t) for t in rows["text"]], rows["y"].to_numpy(dtype=np.float64))


class _Score:
    """Replaces the last column, a text, by its score."""

    def __init__(self, net: Network):
        self.net = net

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [t or b"" for t in batch.column(batch.num_columns - 1).to_pylist()]
            scores = [self.net.probability(texts[k : k + 64]) for k in range(0, len(texts), 64)]
            out = pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], batch.schema.names)


def score(docs: DataFrame, net: Network, *, text_col="text", keep=None, score_col="score") -> DataFrame:
    """docs' columns (or those in keep) and score_col: the probability of label 1 of each whole text.

    A column of docs called score_col is left out: name another one to keep it. A null text
    is scored as an empty one. Every row is scored on its own, so repeated rows agree; an
    empty table gives an empty result.
    """
    columns = [named(c) for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]
    schema = T.StructType([*docs.select(*columns).schema.fields, T.StructField(score_col, T.DoubleType())])
    return mapped(docs.select(*columns, named(text_col).cast("string").cast("binary")), _Score(net), schema)
