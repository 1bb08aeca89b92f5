"""Best-fit packing of tokenised documents into fixed-length sequences.

Each task tokenises its documents and packs them online into a fixed number of open
bins, kept in a bitset keyed by free space: the lowest set bit at or above a piece's
length is the best fit. When every open bin is too small and none may be added, the
fullest closes. What a task's bins still miss at its end is filled in a second round:
there the unfilled bins themselves are the items, packed by the same method.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, staged

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, bin long, offset long, fill long"


class Bins:
    """Bounded-space best fit. place(n) gives (bin, offset); close() yields (bin, fill)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]
        self.bits, self.n_open, self.n = 0, 0, 0
        self.closed: list[tuple[int, int]] = []

    def _put(self, at: int, free: int) -> None:
        if free == 0:
            self.closed.append((at, self.size))
            return
        self.by_free[free].append(at)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        at = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return at

    def place(self, n: int) -> tuple[int, int]:
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            at = self._take(free)
        else:
            if self.n_open >= self.most_open:
                fullest = (self.bits & -self.bits).bit_length() - 1
                self.closed.append((self._take(fullest), self.size - fullest))
            at, free = self.n, self.size
            self.n += 1
        self._put(at, free - n)
        return at, self.size - free

    def close(self) -> list[tuple[int, int]]:
        left = [(at, self.size - free) for free, all_at in enumerate(self.by_free) for at in all_at]
        return self.closed + left


class WordIds:
    """Token ids of a text. Where words stand between single spaces, each is encoded by itself.

    The vocabulary's pre-tokeniser never joins a word with the one after a single
    space, so the ids of a text whose white space is single spaces or single line
    ends are those of its words, each with its leading space. Any other text, and any
    that may name a special token, is encoded as a whole. Of texts with other letters than Latin
    ones, words are looked up in a bounded table. Latin texts, and Latin words that are not in the table, are
    encoded from the same vocabulary's file of ranks, if its path is given: in one call for
    all words of a text, as most distinct words come once and a table would mostly miss them.
    """

    def __init__(self, path: str, ranks_path: str | None = None, most_words: int = 150_000):
        import re
        import struct

        from tokenizers import Tokenizer

        tokens = Tokenizer.from_file(path)
        packed = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        whole = self.whole = lambda text: packed(tokens.encode(text, add_special_tokens=False).ids)
        ranked = self.ranked = _rank_encoder(ranks_path) if ranks_path else None
        other = self.other = re.compile("[^\0-\u024f]").search

        class Table(dict):
            def __missing__(self, word):
                ids = ranked(word) if ranked and not other(word) else whole(word)
                if len(self) >= most_words:
                    self.clear()  # the frequent words are soon back
                self[word] = ids
                return ids

        self.table = Table()

    @staticmethod
    def plain(text: str) -> bool:
        """Whether all white space is single spaces and line ends between words, and nothing is special."""
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ", "<|")):
            return False
        return text.replace("\n", "").isprintable()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.plain(text):
            return self.whole(text)
        if self.ranked and not self.other(text):
            return self.ranked(text)
        # Each word keeps its leading space; a line end is a token of its own.
        words = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")
        return b"".join(map(self.table.__getitem__, words))


def _rank_encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str, ranks_path: str | None) -> WordIds:
    """One table of words per Python worker; it outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path, ranks_path)
    return _ENCODERS[path]


class _Pack:
    def __init__(self, path: str, ranks_path: str | None, size: int, end_id: int, most_open: int):
        self.path, self.ranks_path, self.size, self.end_id, self.most_open = path, ranks_path, size, end_id, most_open

    def __call__(self, batches) -> Iterator:
        import zlib

        import pyarrow as pa
        from pyspark import TaskContext

        ids_of, bins, task = encoder(self.path, self.ranks_path), Bins(self.size, self.most_open), TaskContext.get().partitionId()
        end = self.end_id.to_bytes(4, "little")

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "bin", "offset", "fill"]
        types = [pa.int64(), pa.int32(), *[pa.int64()] * 7]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = ids_of(text or "") + end
                n = len(raw) // 4
                at, length, piece = 0, n % self.size or self.size, 0
                while at < n:
                    place, offset = bins.place(length)
                    rows.append((doc_id, piece, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), task, place, offset, None))
                    at, length, piece = at + length, self.size, piece + 1
            yield table(rows)
        # A bin's fill is known at the end: one row for each bin that is not full.
        fills = [(None, None, None, None, None, task, at, None, fill) for at, fill in bins.close() if fill < self.size]
        for k in range(0, len(fills), 10_000):
            yield table(fills[k : k + 10_000])


class _Refill:
    """Packs unfilled bins into sequences: (task, bin, fill) to (task, bin, home, shift)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open

    def __call__(self, batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bins, me = Bins(self.size, self.most_open), TaskContext.get().partitionId()
        for batch in batches:
            fills = batch.column(2).to_pylist()
            places = [bins.place(n) for n in fills]
            home = [-1 - ((me << 40) + at) for at, _ in places]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home, pa.int64()), pa.array([o for _, o in places], pa.int64())], ["t", "b", "home", "shift"])


def pack(docs: DataFrame, *, tokenizer_path: str, ranks_path: str | None = None, id_col="doc_id", text_col="text", size=1024, end_id=2, most_open=4096, refill_rows=50_000) -> DataFrame:
    """Packs all documents into sequences of at most size tokens.

    A document's ids are those of the tokeniser file, then end_id; ranks_path is the same
    vocabulary as ranks, which only makes it faster. Only a document
    longer than size is cut: its first piece takes the remainder, the others size.
    Returns one row per piece: doc_id, piece (from 0), start (the document's ids
    before it), length, ids_crc32 (of the little-endian unsigned 32-bit ids),
    sequence_id, offset (the place in the sequence, without gaps from 0).

    Null and empty texts are packed as end_id alone. Rows with equal ids are packed
    each on its own. An empty table gives no rows. most_open is the number of open
    bins of a task; refill_rows is about how many unfilled bins a second-round task
    packs. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    placed = staged(mapped(rows, _Pack(tokenizer_path, ranks_path, size, end_id, most_open), SCHEMA), "placed")
    unfilled = placed.where("fill is not null").select("task", "bin", "fill")
    parts = max(1, -(-unfilled.count() // refill_rows))
    # Few rows in place of every text: the longest first, so that short ones fill the gaps.
    homes = staged(
        unfilled.repartition(parts, F.xxhash64("task", "bin")).sortWithinPartitions(F.desc("fill"), "task", "bin")
        .mapInArrow(_Refill(size, most_open), "t long, b long, home long, shift long"), "homes",
    )
    pieces = placed.where("fill is null").drop("fill")
    joined = pieces.join(homes, (F.col("task") == F.col("t")) & (F.col("bin") == F.col("b")), "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("home", F.shiftleft(F.col("task"), 40) + F.col("bin")).alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
