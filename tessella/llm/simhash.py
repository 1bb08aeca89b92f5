"""SimHash near-duplicates by generalised pigeonhole.

within_bits(): documents become 64-bit fingerprints of their word shingles. Bits that go
together are put into one part, so that the parts are near to independent of each other; a
dynamic programme gives each part its own threshold (-1: not probed), so that the
thresholds meet the pigeonhole bound at the fewest estimated candidates. Every
part is probed and every candidate verified on all bits. Only minima flow between
stages: copies meet in one row per fingerprint, and where very many fingerprints
share a part's value they are linked through their one-bit neighbours, never in pairs.

near_duplicates(): the same steps on fingerprints of sets of shingles; what they link are candidates,
verified on the whole sets. A similarity of 0.8 is about ten of 64 bits, and thresholds for so many
would make candidates of a hundredth of all pairs. For the pairs beyond DISTANCE the fingerprint is made wider: BLOCKS blocks of 64 bits, each the SimHash of the DRAWN shingles that come
first in the block's own hash order. The bits of a block go together entirely, so blocks are
the parts, each with threshold 0; candidates are verified on their whole sets of shingles.
"""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, mapped, named, staged

BITS = 64
#: Bits within which op2's fingerprints link; links() is laid out for it.
DISTANCE = 2
#: Blocks of a wide fingerprint, and shingles drawn for each: a pair of similarity s agrees in none with a chance of (1 - s**DRAWN)**BLOCKS, 5e-8 at 0.8.
BLOCKS, DRAWN = 32, 4
#: Buckets of more fingerprints than this are linked through neighbours, not in pairs.
PAIRED = 64


def shingle_hashes(text: bytes, width: int, seed: int):
    """XXH64 of the text's word shingles, repeats included, in arrays of up to 100,000."""
    from itertools import repeat

    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space
    if not words:
        return
    joined = b" ".join(words)
    if len(words) <= width:
        yield np.array([xxh64_intdigest(joined, seed)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-width]]).tolist()
    ends = (ends[width - 1 :] - 1).tolist()
    for k in range(0, len(starts), 100_000):
        pieces = map(joined.__getitem__, map(slice, starts[k : k + 100_000], ends[k : k + 100_000]))
        yield np.fromiter(map(xxh64_intdigest, pieces, repeat(seed)), np.uint64)


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(*h.shape, 8), axis=-1, bitorder="little")


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is in over half the XXH64 of the text's word shingles."""
    return majority(shingle_hashes(text, width, seed))


def majority(hashes) -> int:
    """The bits that are set in over half the hashes, which come in arrays."""
    n, counts = 0, np.zeros(BITS, np.int64)
    for h in hashes:
        counts += bits_of(h).sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


class _Fingerprints:
    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t or b"", self.width, self.seed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, *, id_col="doc_id", text_col="text", width=3, seed=42) -> DataFrame:
    """(id, fp) for every row; the fingerprint as a signed long. A null text has no words: zero."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return mapped(rows, _Fingerprints(width, seed), "id long, fp long")


class _BitCounts:
    """For each task, how often each two bits are set together."""

    def __call__(self, batches):
        import pyarrow as pa

        total = np.zeros((BITS, BITS))
        for batch in batches:
            fp = batch.column(0).to_numpy()
            bits = np.unpackbits(fp.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        cell = np.arange(BITS * BITS, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel().astype(np.int64))], ["cell", "n"])


def together(fps: DataFrame) -> np.ndarray:
    """The 64 x 64 counts of bits set together, over all fingerprints: 4096 sums reach the driver."""
    rows = fps.select("fp").mapInArrow(_BitCounts(), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(BITS, BITS)


def correlated_parts(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m parts of near-equal size: each grows from its most correlated pair by the bit nearest to it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, -1)
    left, parts = list(range(BITS)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        sub = corr[np.ix_(left, left)]
        at = int(sub.argmax()) // len(left) if len(left) > 1 else 0
        part = [left.pop(at)]
        while len(part) < size:
            part.append(left.pop(int(corr[np.ix_(part, left)].mean(0).argmax())))
        parts.append(sorted(part))
    return parts


def within(rates: np.ndarray, most: int) -> np.ndarray:
    """The chance that at most 0..most of independent bits differ."""
    chance = np.zeros(most + 2)
    chance[0] = 1
    for r in rates:
        chance[1:] = chance[1:] * (1 - r) + chance[:-1] * r
        chance[0] *= 1 - r
    return chance.cumsum()[: most + 1]


def allocate(cost: np.ndarray, distance: int) -> list[int]:
    """Thresholds t_i >= -1 with sum distance - m + 1 at the least total cost; cost[i][t + 1]."""
    m = len(cost)
    spare = distance + 1  # with s_i = t_i + 1 >= 0, the s_i sum to distance + 1
    best = np.full(spare + 1, np.inf)
    best[0], chosen = 0, []
    for i in range(m):
        now, pick = np.full(spare + 1, np.inf), np.zeros(spare + 1, int)
        for total in range(spare + 1):
            for s in range(total + 1):
                if (c := best[total - s] + cost[i][s]) < now[total]:
                    now[total], pick[total] = c, s
        best = now
        chosen.append(pick)
    out, total = [], spare
    for pick in reversed(chosen):
        out.append(int(pick[total]) - 1)
        total -= pick[total]
    return out[::-1]


def plan(fps: DataFrame, n: int, distance: int, parts_from=(2, 3, 4, 5)) -> list[tuple[list[int], int]]:
    """(bits of the part, threshold) of the parts to probe, at the fewest estimated candidates.

    Few parts make long keys with more probes: the more fingerprints there are, the fewer parts pay.
    """
    both = together(fps)
    p = np.diag(both) / max(n, 1)
    differ, pairs = 2 * p * (1 - p), n * (n - 1) / 2
    best = None
    for m in parts_from:
        parts = correlated_parts(both, n, m)
        cost = []
        for part in parts:
            near = within(differ[part], distance)
            probes = np.cumsum([comb(len(part), e) for e in range(distance + 1)])
            cost.append([0.0, *(pairs * near + n * probes)])
        chosen = allocate(np.array(cost), distance)
        total = sum(c[t + 1] for c, t in zip(cost, chosen))
        if best is None or total < best[0]:
            best = total, [(part, t) for part, t in zip(parts, chosen) if t >= 0]
    return best[1]


def _mask(bits) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _near_masks(bits: list[int], most: int) -> list[int]:
    from itertools import combinations

    return [_mask(c) for e in range(most + 1) for c in combinations(bits, e)]


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between fingerprints at most DISTANCE bits apart, enough for every component.

    fps: (fp), one row per fingerprint. In a bucket of up to PAIRED fingerprints
    every pair is verified; the members of a larger one are linked through all values
    within half the distance of them: two values within 2 bits always share such a neighbour.
    """
    n = fps.count()
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    chosen = plan(fps, n, DISTANCE)
    part = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.expr(f"fp & {_mask(bits)}L").alias("key")) for i, (bits, t) in enumerate(chosen)
    ])).alias("p")
    index = staged(fps.select("fp", part).select("fp", "p.part", "p.key"), "parts")
    sizes = index.groupBy("part", "key").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > PAIRED).select("part", "key")
    # Probes: the values near a fingerprint's own within its part's threshold.
    near = F.lit(None).cast("array<long>")
    for i, (bits, t) in enumerate(chosen):
        if t:
            near = F.when(F.col("part") == i, F.array(*[F.lit(x) for x in _near_masks(bits, t)])).otherwise(near)
    flips = F.explode(F.coalesce(near, F.array(F.lit(0).cast("long"))))
    probe = index.select("part", F.col("fp").alias("fp2"), F.col("key").alias("own"), flips.alias("flip"))
    probe = probe.select("part", "fp2", F.expr("own ^ flip").alias("key"))
    small = index.join(large, ["part", "key"], "left_anti")
    pairs = small.join(probe, ["part", "key"]).where((F.col("fp") < F.col("fp2")) & (F.expr("bit_count(fp ^ fp2)") <= DISTANCE))
    direct = pairs.select(F.col("fp2").alias("a"), F.col("fp").alias("b"))
    # Members of large buckets, and what probes into them from other buckets.
    crowd = index.join(large, ["part", "key"], "left_semi").select("fp")
    if any(t for _, t in chosen):
        crowd = crowd.unionAll(probe.join(large, ["part", "key"], "left_semi").select(F.col("fp2").alias("fp")))
    ones = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])) for b in range(BITS)])
    around = crowd.distinct().select("fp", F.explode(ones).alias("flip")).select("fp", F.expr("fp ^ flip").alias("z"))
    first = around.groupBy("z").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    through = around.join(first, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()
    return direct.unionAll(through)


def within_bits(docs: DataFrame, *, id_col="doc_id", text_col="text", width=3, seed=42) -> DataFrame:
    """One row per document: id, fp (signed long), component_id.

    component_id is the smallest id reachable through fingerprints at most DISTANCE
    bits apart, itself included. Null, empty and blank texts have fingerprint zero,
    linked like any other; repeated ids are ordinary rows; a null id is never the
    smallest (a component of null ids alone has none); an empty table gives an empty result. Other columns are not looked at.
    """
    prints = staged(fingerprints(docs, id_col=id_col, text_col=text_col, width=width, seed=seed), "fingerprints")
    fps = staged(prints.groupBy("fp").agg(F.min("id").alias("id")), "distinct")
    found = components(links(fps.select("fp")))
    # The smallest id of a component is a minimum over its fingerprints' smallest ids.
    rooted = fps.join(found.withColumnRenamed("id", "of"), F.col("fp") == F.col("of"), "left")
    rooted = staged(rooted.select("fp", "id", F.coalesce("component", "fp").alias("root")), "rooted")
    low = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    rooted = staged(rooted.join(low, "root").select("fp", "component_id"), "components")
    return prints.join(rooted, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


_ORDERS = np.random.default_rng(3).integers(1, 2**63, BLOCKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, width: int, seed: int) -> np.ndarray:
    """The text's different shingles, as sorted hashes."""
    parts = [np.unique(h) for h in shingle_hashes(text, width, seed)]
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def wide_fingerprint(shingles: np.ndarray) -> np.ndarray:
    """BLOCKS blocks of 64 bits: each the SimHash of the DRAWN shingles first in the block's order (all, if fewer)."""
    first = np.empty((BLOCKS, 0), np.uint64)
    for k in range(0, len(shingles), 1 << 14):
        first = np.concatenate([first, _mixed(shingles[k : k + (1 << 14)] * _ORDERS[:, None])], 1)
        if first.shape[1] > DRAWN:
            first = np.partition(first, DRAWN - 1, axis=1)[:, :DRAWN]
    bits = 2 * bits_of(first).sum(1, dtype=np.int64) > first.shape[1]
    blocks = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return _mixed(blocks + np.arange(BLOCKS, dtype=np.uint64) * _ORDERS)  # equal bits in other blocks are another key


class _Sign:
    """(id, mark, text) to (id, mark, of: a digest of the set of shingles, fp: its fingerprint, keys: its wide one)."""

    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed

    def __call__(self, batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            sets = [shingle_set(t or b"", self.width, self.seed) for t in batch.column(2).to_pylist()]
            of = pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            fps = [majority(s[k : k + 100_000] for k in range(0, len(s), 100_000)) for s in sets]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            keys = pa.array([wide_fingerprint(s).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), of, fp, keys], ["id", "mark", "of", "fp", "keys"])


class _Sets:
    """(id, text) to (id, n, shingles)."""

    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed

    def __call__(self, batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t or b"", self.width, self.seed).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["id", "n", "shingles"])


def _tile(similarity: float):
    """In two parts of a bucket: the smallest id that flows along all links between their members."""

    def run(key, table):
        import pyarrow as pa

        i, j = key[1].as_py(), key[2].as_py()
        ids, sub, n = (table.column(c).to_numpy() for c in ("id", "sub", "n"))
        shingles = table.column("shingles").combine_chunks()
        flat, sizes = shingles.flatten().to_numpy(), n.astype(np.int64)
        _, word, count = np.unique(flat, return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        rare = count[word] < 2
        again = np.cumsum(count >= 2) - 1
        row, word = row[~rare], again[word[~rare]]
        order = np.argsort(word, kind="stable")
        row, word = row[order], word[order]
        a, b = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
        place = np.empty(len(ids), np.int64)
        common = np.zeros((len(a), len(b)), np.float32)
        ends = np.searchsorted(word, np.arange(0, word[-1] + 2048 if len(word) else 0, 2048))
        for k, (lo, hi) in enumerate(zip(ends, [*ends[1:], len(word)])):
            # Shingles that two or more hold, 2048 at a time: one product counts them for all pairs.
            has = np.zeros((len(ids), 2048), np.float32)
            has[row[lo:hi], word[lo:hi] - 2048 * k] = 1
            common += has[a] @ has[b].T
        near = common >= similarity * (n[a][:, None] + n[b][None, :] - common) - 1e-6
        root = ids.copy()
        while True:
            top = np.iinfo(np.int64).max
            place[:] = root
            place[a] = np.minimum(place[a], np.where(near, root[b][None, :], top).min(1, initial=top))
            place[b] = np.minimum(place[b], np.where(near, place[a][:, None], top).min(0, initial=top))
            if (place == root).all():
                break
            root[:] = place
        moved = root != ids
        return pa.table({"a": pa.array(ids[moved]), "b": pa.array(root[moved])})

    return run


def _near_pairs(sets: DataFrame) -> DataFrame:
    """(a, b) with a < b: ids of sets whose fingerprints are linked, each fingerprint by its smallest id, and that id with the others of its fingerprint."""
    # A set without shingles has no keys, and is only alike to itself.
    some = sets.where(F.size("keys") > 0).select("id", "fp")
    fps = staged(some.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    ends = links(fps.select("fp")).distinct()
    for end in ("a", "b"):
        ends = ends.join(fps.select(F.col("fp").alias(end), F.col("first").alias(f"of_{end}")), end)
    same = some.join(fps, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    return ends.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).unionAll(same)


def near_duplicates(docs: DataFrame, *, id_col="doc_id", text_col="text", width=5, seed=42, similarity=0.8, part_rows=1024) -> DataFrame:
    """One row per id that is not null: id, mark (xxhash64 of its text), component_id.

    component_id is the smallest id reachable through documents whose sets of width-word
    shingles (fewer words: the whole sequence) have a Jaccard similarity of at least similarity.
    Documents of one set, those without words among them, are one. Rows that repeat an id are one
    document, and its text is the one with the smallest mark. An empty table gives an empty
    result; other columns are not looked at.

    Fingerprints of the sets link as in within_bits(), and each link is verified on the sets, as are
    sets of one fingerprint against its smallest id. For pairs further apart,
    documents that agree in a block of the wide fingerprint meet in a bucket. Each is verified
    against the bucket's smallest id; a bucket that is not one component then is verified in
    all its pairs, in tiles of part_rows members, of which only the components come out.
    """
    text = named(text_col).cast("string").cast("binary")
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("mark"), text.alias("text")).where("id is not null")
    signed = staged(mapped(rows, _Sign(width, seed), "id long, mark long, of binary, fp long, keys array<long>"), "signed")
    one = staged(signed.groupBy("id").agg(F.min(F.struct("mark", "of", "fp", "keys")).alias("s")).select("id", "s.*"), "documents")
    reps = staged(one.groupBy("of").agg(F.min(F.struct("id", "mark", "fp", "keys")).alias("s")).select("of", "s.*"), "sets")
    keys = reps.select("id", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    members = staged(keys.join(buckets, "key"), "members")
    near = staged(_near_pairs(reps), "near")
    ids = members.select("id").unionAll(near.select("a")).unionAll(near.select("b")).distinct()
    asked = reps.join(ids, "id", "left_semi").select("id", "mark")
    texts = rows.join(asked, ["id", "mark"], "left_semi").dropDuplicates(["id"]).select("id", "text")
    sets = staged(mapped(texts, _Sets(width, seed), "id long, n int, shingles array<long>"), "shingles")
    pairs = members.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).unionAll(near).distinct()
    with_sets = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("of_a")), "a")
    with_sets = with_sets.join(sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("of_b")), "b")
    fits = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - 1e-6
    common = F.size(F.array_intersect("of_a", "of_b"))
    linked = staged(with_sets.where(fits).where(common >= similarity * (F.col("n_a") + F.col("n_b") - common) - 1e-6).select("a", "b"), "links")
    found = components(linked)
    # What is left: buckets of three or more that hold several components.
    told = members.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    split = told.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("low"), F.max("c").alias("high")).where("m > 2 and low <> high")
    split = split.select("key", F.ceil(F.col("m") / part_rows).cast("int").alias("parts"))
    dealt = members.select("key", "id").join(split, "key").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tiles = dealt.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("sub", "t")).withColumn("j", F.greatest("sub", "t"))
    tiles = tiles.join(sets, "id").select("key", "i", "j", "id", "sub", "n", "shingles")
    more = tiles.groupBy("key", "i", "j").applyInArrow(_tile(similarity), "a long, b long")
    found = staged(components(staged(linked.unionAll(more).distinct(), "links")), "components")
    classes = reps.select("of", F.col("id").alias("rep")).join(found, F.col("rep") == F.col("id"), "left").select("of", F.coalesce("component", "rep").alias("component_id"))
    return one.join(classes, "of").select(F.col("id").alias(id_col), "mark", "component_id")


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest id stays.

    Of rows that repeat that id one stays, the same one on every run (see near_duplicates; of equal
    texts the row whose columns have the smallest hash); rows with a null id all stay, as no
    group can name one of them. Columns are those of docs, whatever they are called.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    keep = near_duplicates(docs, **options).where(named(id_col) == F.col("component_id")).select(named(id_col).alias("kept_id"), F.col("mark").alias("kept_mark"))
    # By place, as columns of docs may be called anything.
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    own_id, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    mark, hashed = F.coalesce(F.xxhash64(text.cast("string").cast("binary")), F.lit(0)), F.xxhash64(F.to_json(F.struct(*rows.columns)))
    # Joined by the id alone, so that the window needs no exchange of its own.
    found = rows.join(keep, (own_id.cast("long") == F.col("kept_id")) & (mark.bitwiseXOR(F.col("kept_mark")) == 0))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("kept_id").orderBy(hashed))).where("place = 1")
    return found.select(*rows.columns).unionAll(rows.where(own_id.isNull())).toDF(*docs.columns)
