"""Removal of passages that repeat across documents: a depth-limited radix sort of suffixes.

Suffixes are told apart only through `window` bytes, in passes over ever longer
digits; equal groups of the last pass are exactly the repeated windows.

1. First digit: the window's anchor, the gram of `gram` bytes in it with the smallest hash;
   its leading bits deal it to a bucket. All windows that follow each other with one
   anchor make a segment, and one entry stands for them all.
2. Second digit: the whole segment. Windows of equal segments are equal; an anchor with
   one segment has no repeats elsewhere. Both are settled here.
3. Last digit: the window itself, for segments that share their anchor with others.

Digits are compared as hashes: 48 bits for an anchor and 64 for a segment under it, 88
for a window. Entries of a chunk of documents go to a bucket in one packed row and the
answer comes back in one, so the shuffle holds fourteen bytes for each anchor, not a row for
every window. An anchor with several segments in a chunk is salted: its entries are dealt by
their segments as well, and a single mark tells the anchor's bucket of them, which so
gets one entry for each chunk however many documents share the anchor. The chunks
are a bucketed table: passes are joined to it without moving the texts again.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffles_removed, stage_path, staged

LOW = np.uint64((1 << 24) - 1)
BLOCK = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MIX = np.uint64(0xD6E8FEB86659FD93)
#: A random 64-bit value for each byte.
BYTES, BYTES_2 = np.random.default_rng(1).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Scan:
    """Cuts the windows of a chunk's documents into segments by their anchors."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        size = 2 * BLOCK + window + 1
        self.up, self.down = _powers(BASE, size), _powers(pow(BASE, -1, 1 << 64), size)

    def mixed(self, h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(29))) * MIX
        return h ^ (h >> np.uint64(32))

    def sums(self, x: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Sums from which the hash of any stretch of x is one difference and one product."""
        out = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(table[x] * self.up[: len(x)], out=out[1:])
        return out

    def blocks(self, offsets: np.ndarray):
        """(first byte, end, first document, end) of stretches of about BLOCK bytes; a longer document is cut, with overlap."""
        doc, n = 0, len(offsets) - 1
        while doc < n:
            first = doc
            while doc < n and (doc == first or offsets[doc + 1] - offsets[first] <= BLOCK):
                doc += 1
            at, end = int(offsets[first]), int(offsets[doc])
            if end - at <= BLOCK:
                yield at, end, first, doc
            else:
                for k in range(at, max(end - self.window + 1, at + 1), BLOCK):
                    yield k, min(k + BLOCK + self.window - 1, end), first, doc

    def segments(self, buf: np.ndarray, offsets: np.ndarray):
        """For each block: (first byte, anchor, segment, first window, last window, document), windows from the chunk's start."""
        w = self.window - self.gram + 1
        for at, end, first, last in self.blocks(offsets):
            n = end - at
            if n < self.window:
                continue
            s = self.sums(buf[at:end], BYTES)
            g = n - self.gram + 1
            v = self.mixed((s[self.gram :] - s[:g]) * self.down[:g])
            low = (v & ~LOW) | np.arange(g, dtype=np.uint64)
            span = 1
            while 2 * span <= w:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if span < w:
                low = np.minimum(low[: span - w], low[w - span :])
            anchor_at = (low & LOW).astype(np.int64)
            starts = np.maximum(offsets[first:last] - at, 0)
            ends = np.minimum(offsets[first + 1 : last + 1] - at, n) - self.window + 1
            some = ends > starts
            edge = np.zeros(n + 2, np.int32)
            edge[starts[some]] += 1
            edge[ends[some]] -= 1
            windows = np.flatnonzero(np.cumsum(edge[: n - self.window + 1]))
            if not len(windows):
                continue
            own = anchor_at[windows]
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            lo, hi = windows[np.concatenate([[0], cut])], windows[np.concatenate([cut, [len(windows)]]) - 1]
            p, e = own[np.concatenate([[0], cut])], hi + self.window
            h = (s[e] - s[lo]) * self.down[lo] + (p - lo).astype(np.uint64) * MIX + (e - lo).astype(np.uint64) * np.uint64(BASE)
            doc = np.searchsorted(offsets[first:last] - at, lo, side="right") - 1 + first
            # The smallest hashes are small: mixed once more, their leading bits are even.
            yield at, self.mixed(v[p] + np.uint64(BASE)) >> np.uint64(16), self.mixed(h), lo + at, hi + at, doc

    def all_segments(self, buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        parts = [x[1:] for x in self.segments(buf, offsets)]
        if not parts:
            return [np.empty(0, np.uint64)] * 2 + [np.empty(0, np.int64)] * 3
        return [np.concatenate(x) for x in zip(*parts)]

    def windows(self, buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, 64 bits, 24 bits) of every window of segments lo..hi."""
        size = hi - lo + 1
        start = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
        block = start // BLOCK
        for b in np.unique(block):
            rows = np.flatnonzero(block == b)
            at = int(b) * BLOCK
            x, k = buf[at : at + BLOCK + self.window], start[rows] - at
            for out, table in ((one, BYTES), (two, BYTES_2)):
                s = self.sums(x, table)
                out[rows] = self.mixed((s[k + self.window] - s[k]) * self.down[k])
        return start, one, two >> np.uint64(40)


def _bytes_of(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _values_of(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


#: Rows to a bucket: a chunk's distinct keys, the smallest id of each as runs of (id, count), and where the largest is another, its place and the id.
TO_BUCKET = "bucket long, chunk long, major binary, minor binary, ids binary, counts binary, places binary, highs binary"
#: Rows back to a chunk: for each key, in the order it was sent in, two bits.
TO_CHUNK = "chunk long, bucket long, later binary, shared binary"
WIDTHS = {1: (6, 8), 2: (8, 3)}


class _Keys:
    """The distinct keys of a chunk's entries, with their smallest and largest ids, dealt to buckets.

    A key is sent once however many entries of the chunk have it: buckets see a key once for each chunk.
    """

    def __init__(self, major: np.ndarray, minor: np.ndarray, ids: np.ndarray, bits: int, buckets: int):
        order = np.lexsort((minor, major))
        a, b = major[order], minor[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        first, self.ids = np.flatnonzero(new), ids
        low, high = (f.reduceat(ids[order], first) if len(first) else ids for f in (np.minimum, np.maximum))
        # By bucket (the leading bits of the major key scaled to it), then by id, so that ids come in runs.
        top = (a[first] >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
        dealt = np.lexsort((low, top))
        self.major, self.minor, self.low, self.high = a[first][dealt], b[first][dealt], low[dealt], high[dealt]
        self.ends = np.searchsorted(top[dealt], np.arange(buckets + 1, dtype=np.uint64))
        place = np.empty(len(first), np.int64)
        place[dealt] = np.arange(len(first))
        #: The key of each entry.
        self.of = np.empty(len(order), np.int64)
        self.of[order] = place[np.cumsum(new) - 1]

    def sent(self, chunk: int, widths) -> pa.Table:
        rows = []
        for b in range(len(self.ends) - 1):
            own = slice(self.ends[b], self.ends[b + 1])
            if own.start < own.stop:
                low, high = self.low[own], self.high[own]
                first = np.concatenate([[0], np.flatnonzero(low[1:] != low[:-1]) + 1])
                counts = np.diff(np.concatenate([first, [len(low)]])).astype("<u4")
                places = np.flatnonzero(high != low)
                rows.append((
                    b, chunk, _bytes_of(self.major[own], widths[0]), _bytes_of(self.minor[own], widths[1]), low[first].astype("<i8").tobytes(), counts.tobytes(),
                    places.astype("<u4").tobytes(), high[places].astype("<i8").tobytes(),
                ))
        names = ["bucket", "chunk", "major", "minor", "ids", "counts", "places", "highs"]
        types = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(zip(names, types))})

    def applied(self, replies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """For each entry: whether a smaller id has its key, and if not, whether its major key is shared with other keys."""
        later, shared = np.zeros(len(self.low), bool), np.zeros(len(self.low), bool)
        for r in replies:
            own = slice(self.ends[r["bucket"]], self.ends[r["bucket"] + 1])
            later[own] = np.unpackbits(np.frombuffer(r["later"], np.uint8), count=own.stop - own.start).astype(bool)
            shared[own] = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=own.stop - own.start).astype(bool)
        later = later[self.of] | (self.ids > self.low[self.of])
        return later, shared[self.of] & ~later


def _answer(widths):
    """In a bucket: which chunks' keys a smaller id has elsewhere, and which share the major key with other keys."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        major = np.concatenate([_values_of(r["major"], widths[0]) for r in rows])
        minor = np.concatenate([_values_of(r["minor"], widths[1]) for r in rows])
        sizes = [len(r["major"]) // widths[0] for r in rows]
        ids = np.concatenate([np.repeat(np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["counts"], "<u4")) for r in rows])
        highs = ids.copy()
        for r, start in zip(rows, np.cumsum([0, *sizes])):
            highs[start + np.frombuffer(r["places"], "<u4").astype(np.int64)] = np.frombuffer(r["highs"], "<i8")
        order = np.lexsort((minor, major))
        a, b = major[order], minor[order]
        new_a = np.concatenate([[True], a[1:] != a[:-1]])
        new_b = new_a | np.concatenate([[True], b[1:] != b[:-1]])
        first = np.flatnonzero(new_b)
        lowest = np.minimum.reduceat(ids[order], first)
        later, shared = np.empty(len(ids), bool), np.empty(len(ids), bool)
        later[order] = ids[order] > np.repeat(lowest, np.diff(np.concatenate([first, [len(a)]])))
        # Several keys under one major key, of more than one document.
        at = np.flatnonzero(new_a)
        mixed = (np.add.reduceat(new_b.astype(np.int64), at) > 1) & (np.minimum.reduceat(ids[order], at) < np.maximum.reduceat(highs[order], at))
        shared[order] = np.repeat(mixed, np.diff(np.concatenate([at, [len(a)]])))
        ends = np.cumsum(sizes)
        bits = lambda x: pa.array([np.packbits(x[e - n : e]).tobytes() for n, e in zip(sizes, ends)], pa.binary())
        return pa.table({
            "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] for r in rows], pa.int64()),
            "later": bits(later), "shared": bits(shared),
        })

    return run


class _Pass:
    """What the three passes do with a chunk."""

    def __init__(self, window: int, gram: int, buckets: int):
        self.window, self.gram, self.buckets = window, gram, buckets

    def opened(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("mark", "ascending")]).combine_chunks()
        texts = table.column("data").to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        return table, np.frombuffer(b"".join(texts), np.uint8), offsets, table.column("id").to_numpy(), Scan(self.window, self.gram)

    def salted(self, scan: Scan, anchor: np.ndarray, segment: np.ndarray, ids: np.ndarray, chunk: int) -> tuple[_Keys, np.ndarray]:
        """The keys of a chunk's segments, and for each segment whether other documents of the chunk have another one under its anchor."""
        order = np.lexsort((segment, anchor))
        a, b, i = anchor[order], segment[order], ids[order]
        new_a = np.ones(len(a), bool)
        new_a[1:] = a[1:] != a[:-1]
        new_b = new_a.copy()
        new_b[1:] |= b[1:] != b[:-1]
        at = np.flatnonzero(new_a)
        mixed, low, high = np.zeros(len(a), bool), *((f.reduceat(i, at) if len(at) else i) for f in (np.minimum, np.maximum))
        if len(at):
            several = (np.add.reduceat(new_b.astype(np.int64), at) > 1) & (low < high)
            mixed[order] = np.repeat(several, np.diff(np.concatenate([at, [len(a)]])))
            low, high, at = low[several], high[several], at[several]
        # A mark for each salted anchor: a key of this chunk alone, with the anchor's smallest and largest id.
        own = a[at]
        mark = scan.mixed(own + scan.mixed(np.full(len(own), chunk, np.uint64) + np.uint64(BASE)))
        major = np.where(mixed, scan.mixed(anchor * MIX ^ segment) >> np.uint64(16), anchor)
        return _Keys(np.concatenate([major, own, own]), np.concatenate([segment, mark, mark]), np.concatenate([ids, low, high]), 48, self.buckets), mixed

    def first(self, table: pa.Table) -> pa.Table:
        table, buf, offsets, ids, scan = self.opened(table)
        anchor, segment, _, _, doc = scan.all_segments(buf, offsets)
        chunk = table.column("chunk")[0].as_py()
        return self.salted(scan, anchor, segment, ids[doc], chunk)[0].sent(chunk, WIDTHS[1])

    def _settled(self, scan, buf, offsets, ids, chunk, replies):
        anchor, segment, lo, hi, doc = scan.all_segments(buf, offsets)
        keys, mixed = self.salted(scan, anchor, segment, ids[doc], chunk)
        later, shared = (x[: len(doc)] for x in keys.applied([r for r in replies if r["step"] == 1]))
        shared |= mixed & ~later
        start, one, two = scan.windows(buf, lo[shared], hi[shared]) if shared.any() else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64))
        return lo[later], hi[later], start, one, two, np.repeat(doc[shared], (hi - lo + 1)[shared])

    def second(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, buf, offsets, ids, scan = self.opened(table)
        chunk = table.column("chunk")[0].as_py()
        _, _, _, one, two, doc = self._settled(scan, buf, offsets, ids, chunk, replies.to_pylist())
        return _Keys(one, two, ids[doc], 64, self.buckets).sent(chunk, WIDTHS[2])

    def third(self, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, buf, offsets, ids, scan = self.opened(table)
        replies = replies.to_pylist()
        lo, hi, start, one, two, doc = self._settled(scan, buf, offsets, ids, table.column("chunk")[0].as_py(), replies)
        later, _ = _Keys(one, two, ids[doc], 64, self.buckets).applied([r for r in replies if r["step"] == 2])
        edge = np.zeros(len(buf) + 1, np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi + self.window, -1)
        np.add.at(edge, start[later], 1)
        np.add.at(edge, start[later] + self.window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        spans, kept = [], []
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = gone[a:b]
            if not own.any():
                spans.append([])
                kept.append(buf[a:b].tobytes())
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2])])
            kept.append(buf[a:b][~own].tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"id": table.column("own_id"), "n_bytes": pa.array(np.diff(offsets)), "spans": pa.array(spans, span), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, *, id_col="doc_id", text_col="text", window=50, gram=24, chunk_bytes=8_000_000) -> DataFrame:
    """Removes every byte covered by a window that also starts in a document with a smaller id.

    Texts are UTF-8 bytes, a null text is empty; windows lie within one document, may
    overlap, and are judged on the input. Returns one row per document: id, n_bytes,
    spans (start and end of the maximal removed runs) and kept (the remaining bytes).

    Rows that repeat an id are documents of one id: neither removes from the other. A
    null id counts as larger than any other. Texts shorter than the window are kept; an
    empty table gives an empty result; other columns are not looked at.
    chunk_bytes: bytes of text that a task holds at once; for very large corpora chunks grow
    with the square root of the total, so that packed rows do not become too short.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col).cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), data.alias("data"))
    total = rows.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    chunks = max(1, round(min(total / chunk_bytes, (total / 2800) ** 0.5)))
    rows = rows.withColumn("id", F.coalesce("own_id", F.lit(2**63 - 1))).withColumn("mark", F.xxhash64("data"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "mark"), F.lit(chunks)))
    name = f"tessella_{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        rows.repartition(chunks, "chunk").write.bucketBy(chunks, "chunk").format("parquet").option("path", stage_path(spark, "chunks", name)).saveAsTable(name)
    base, work = spark.table(name), _Pass(window, gram, chunks)

    def answered(sent: DataFrame, step: int) -> DataFrame:
        replies = sent.groupBy("bucket").applyInArrow(_answer(WIDTHS[step]), TO_CHUNK)
        return staged(replies.withColumn("step", F.lit(step)), f"replies{step}")

    def with_replies(replies: DataFrame, function, schema: str) -> DataFrame:
        return base.groupBy("chunk").cogroup(replies.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(function, schema)

    one = answered(base.groupBy("chunk").applyInArrow(lambda t: work.first(t), TO_BUCKET), 1)
    two = answered(with_replies(one, lambda t, r: work.second(t, r), TO_BUCKET), 2)
    result = with_replies(one.unionAll(two), lambda t, r: work.third(t, r), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return result.withColumnRenamed("id", id_col)
