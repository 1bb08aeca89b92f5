"""Embedding near-duplicates on a robust-pruned flat graph.

Exact copies meet in one representative. Representatives of a label are dealt to all
cluster centres about as near to them as the nearest one, and a pruned graph is built in
each of these overlapping shards; clusters that are still large are dealt out again by
centres of their own. The adjacency lists of a vector are united. A greedy search runs
from the shard's medoid (and the query's own node) to the query's neighbourhood, then
expands through every node in range until nothing new is found. Each link is verified
in double precision. A dense shard of many rows is cut, and all pairs of its parts searched.
The links found are audited against brute force, and a poor result is searched for again with more overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, staged

DEGREE, FAR_LINKS, CANDIDATES, ALPHA, BEAM = 24, 8, 64, 1.2, 32
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Most centres a cluster is dealt to at once, and how many of its rows they are chosen from.
FANOUT, SAMPLE = 512, 4096
#: Centres are no nearer to each other than this: what is all nearer is dense and stays together.
APART = 0.8


def build(v: np.ndarray, seed: int = 0) -> np.ndarray:
    """Neighbours of each unit vector, DEGREE pruned near and FAR_LINKS pruned random ones; -1 fills up."""
    n, rng = len(v), np.random.default_rng(seed)
    out = np.full((n, DEGREE + FAR_LINKS), -1, np.int32)
    if n < 2:
        return out
    c = min(CANDIDATES, n - 1)
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        sims = v[rows] @ v.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, c - 1, axis=1)[:, :c]
        out[rows, :DEGREE] = prune(v, rows, near, np.take_along_axis(sims, near, 1), DEGREE)
        far = rng.integers(0, n, (len(rows), 4 * FAR_LINKS))
        far_sims = np.take_along_axis(sims, far, 1)
        out[rows, DEGREE:] = prune(v, rows, far, far_sims, FAR_LINKS)
    return out


def prune(v, rows, candidates, sims, degree) -> np.ndarray:
    """Robust pruning: the nearest candidate stays and removes those much nearer to it than to the row."""
    order = np.argsort(-sims, axis=1)
    candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
    distance = np.sqrt(np.maximum(2 - 2 * sims, 0))
    points, alive = v[candidates], sims > -2
    out, at = np.full((len(rows), degree), -1, np.int32), np.arange(len(rows))
    for k in range(degree):
        pick = alive.argmax(1)
        has = alive[at, pick]
        if not has.any():
            break
        out[has, k] = candidates[at, pick][has]
        between = np.sqrt(np.maximum(2 - 2 * np.einsum("rd,rcd->rc", points[at, pick], points), 0))
        alive &= ~((ALPHA * between <= distance) & has[:, None])
        alive[at, pick] = False
    return out


def search(v: np.ndarray, links: np.ndarray, queries: np.ndarray, own: np.ndarray, threshold: float) -> np.ndarray:
    """found[q, x]: whether the search from the medoid finds x within range of query q.

    own: a query's own node, or -1. links has -1 for no link.
    """
    n, m = len(v), len(queries)
    found = np.zeros((m, n), bool)
    if not n:
        return found
    medoid = int((v @ v.mean(0)).argmax())
    loose = threshold - 0.03  # nodes a little out of range are walked through as well
    for at in range(0, m, 256):
        q = queries[at : at + 256]
        size, me = len(q), np.arange(len(q))
        seen, sims = np.zeros((size, n + 1), bool), np.full((size, n), -2.0)
        seen[:, n] = True  # where -1 points to
        expanded = np.zeros((size, n), bool)

        def reach(who, nodes):
            """Evaluates pairs of query and node that were not seen."""
            new = ~seen[who, nodes]
            who, nodes = who[new], nodes[new]
            seen[who, nodes] = True
            for k in range(0, len(who), 65_536):
                w, x = who[k : k + 65_536], nodes[k : k + 65_536]
                sims[w, x] = np.einsum("pd,pd->p", q[w], v[x])

        reach(me, np.full(size, medoid))
        start = own[at : at + 256]
        reach(me[start >= 0], start[start >= 0])
        # Greedy: each round expands the best node of every query that is not expanded yet.
        beam = min(BEAM, n)
        for turn in range(BEAM):
            open_sims = np.where(expanded, -3.0, sims)
            best = open_sims.argmax(1)
            if turn % 8 == 0:  # what the beam holds at least; it only rises
                floor = np.partition(sims, n - beam, axis=1)[:, n - beam]
            active = (open_sims[me, best] > -2) & (open_sims[me, best] >= floor)
            if not active.any():
                break
            who, nodes = me[active], best[active]
            expanded[who, nodes] = True
            near = links[nodes]
            reach(np.repeat(who, near.shape[1]), near.ravel())
        # Range: everything within it is expanded, until there is nothing new.
        while True:
            who, nodes = np.nonzero((sims >= loose) & ~expanded)
            if not len(who):
                break
            expanded[who, nodes] = True
            for k in range(0, len(who), 16_384):
                near = links[nodes[k : k + 16_384]]
                reach(np.repeat(who[k : k + 16_384], near.shape[1]), near.ravel())
        found[at : at + 256] = sims >= threshold
    return found


def _matrix(column) -> np.ndarray:
    """Vectors of one length, from an Arrow column of lists."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _pick(table):
    """Far-apart centres for a cluster, from its sampled rows."""
    table = table.sort_by("id")
    v, wanted = _matrix(table.column("v")), table.column("wanted")[0].as_py()
    chosen, best = [0], v @ v[0]
    while len(chosen) < min(wanted, len(v)) and best.min() < APART:
        chosen.append(int(best.argmin()))
        best = np.maximum(best, v @ v[chosen[-1]])
    return pa.table({"cell": table.column("cell").take(chosen), "v": table.column("v").take(chosen)})


def _deal(margin: float, overlap: int):
    """Rows of a cluster to the clusters of all its centres that are within margin of the nearest, 2 to overlap of them."""

    def run(rows, centres):
        v, at = _matrix(rows.column("v")), _matrix(centres.column("v"))
        k = min(overlap, len(at))
        near = v @ at.T
        order = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(at) else np.broadcast_to(np.arange(k), (len(v), k))
        sims = np.take_along_axis(near, order, 1)
        rank = np.argsort(np.argsort(-sims, axis=1, kind="stable"), axis=1)
        row, col = np.nonzero((sims >= sims.max(1, keepdims=True) - margin) | (rank < 2))
        cell = rows.column("cell").to_numpy().astype(np.uint64)[row] * MIX + order[row, col].astype(np.uint64) + np.uint64(1)
        cell = (cell ^ (cell >> np.uint64(31))) * MIX
        out = rows.select(["id", "copies", "v"]).take(row)
        n = np.full(len(row), rows.column("n")[0].as_py() if len(row) and len(at) > 1 else 0)
        return out.append_column("cell", pa.array(cell.view(np.int64))).append_column("of", pa.array(n))

    return run


MEMBER = "id long, copies long, v array<double>, cell long"


def clusters(reps: DataFrame, shard_rows: int, part_rows: int, margin: float, overlap: int) -> DataFrame:
    """reps (id, copies, v, cell) with the clusters of about shard_rows rows, before overlap, that each is dealt to.

    Centres come from SAMPLE rows of a cluster at most, the first by a hash; they and the rows are
    dealt to tasks by salted cluster, so that no task holds more than about SAMPLE rows.
    A cluster of more than part_rows rows is divided again, into two clusters a row at most, unless one
    centre is near to all of it or it is more than half of what it was divided from: it is dense.
    """
    done, now, limit = None, reps.withColumn("of", F.lit(2**62)), 4 * shard_rows
    while True:
        sizes = now.groupBy("cell").agg(F.count("*").alias("n"), F.min("of").alias("of"))
        large = staged(sizes.where((F.col("n") > limit) & (2 * F.col("n") <= F.col("of"))).select("cell", "n"), "large")
        small = now.join(large.select("cell"), "cell", "left_anti").select("id", "copies", "v", "cell")
        done = small if done is None else done.unionAll(small)
        if large.isEmpty():
            return done
        rows = now.drop("of").join(large, "cell")
        share = F.pmod(F.xxhash64("id", F.lit("centre")), F.lit(1 << 20)) * F.col("n") < F.lit(SAMPLE << 20)
        wanted = F.least(F.ceil(F.col("n") / shard_rows), F.lit(FANOUT)).cast("int")
        centres = staged(rows.where(share).select("cell", "id", "v", wanted.alias("wanted")).groupBy("cell").applyInArrow(_pick, "cell long, v array<double>"), "centres")
        salts = F.ceil(F.col("n") / SAMPLE).cast("int")
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), salts).cast("int")).select("id", "copies", "v", "cell", "salt", "n")
        to_salts = centres.join(large.select("cell", salts.alias("salts")), "cell").select("cell", "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        dealt = salted.groupBy("cell", "salt").cogroup(to_salts.groupBy("cell", "salt")).applyInArrow(_deal(margin, overlap), f"{MEMBER}, of long")
        now, limit, overlap = staged(dealt, "dealt"), part_rows, 2


def _build(table: pa.Table) -> pa.Table:
    table = table.sort_by("id")
    ids, links = table.column("id").to_numpy(), build(_matrix(table.column("v")))
    return pa.table({"id": ids, "cell": table.column("cell"), "near": pa.array([ids[row[row >= 0]] for row in links], pa.list_(pa.int64()))})


def _links_in(ids: np.ndarray, near) -> np.ndarray:
    """Adjacency lists of sorted ids as rows of positions in ids; ids from other shards are left out."""
    flat = near.combine_chunks().flatten().to_numpy()
    sizes = near.combine_chunks().value_lengths().to_numpy()
    row, at = np.repeat(np.arange(len(ids)), sizes), np.minimum(np.searchsorted(ids, flat), max(len(ids) - 1, 0))
    here = ids[at] == flat if len(ids) else np.zeros(0, bool)
    row, at = row[here], at[here]
    counts = np.bincount(row, minlength=len(ids))
    out = np.full((len(ids), max(1, counts.max(initial=0))), -1, np.int32)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)] = at
    return out


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest cluster that both rows of a pair lie in; rows are filled up with negative fillers that differ."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 14):
        x, y = a[k : k + (1 << 14), :, None], b[k : k + (1 << 14), None, :]
        out[k : k + (1 << 14)] = np.where(x == y, x, np.iinfo(np.int64).max).min((1, 2))
    return out


def _search(threshold: float):
    def run(key, table):
        cell, i, j = (k.as_py() for k in key)
        sets = []
        for part in [i] if i == j else [i, j]:
            p = table.filter(pc.equal(table.column("sub"), part)).sort_by("id")
            ids, lists = p.column("id").to_numpy(), p.column("cells").to_pylist()
            width = max(map(len, lists), default=1)
            # Clusters are compared by the numbers that they have in this tile; fillers of i and j differ.
            cells = np.array([x + [None] * (width - len(x)) for x in lists], object).reshape(len(ids), width)
            sets.append((ids, _matrix(p.column("v")), _links_in(ids, p.column("near")), p.column("copies").to_numpy(), cells))
        a, b = sets[0], sets[-1]
        if not len(a[0]) or not len(b[0]):
            return pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if i == j:
            found = search(a[1], a[2], a[1], np.arange(len(a[0])), threshold)
            np.fill_diagonal(found, False)
            found |= found.T
        else:
            found = search(b[1], b[2], a[1], np.full(len(a[0]), -1), threshold)
            found |= search(a[1], a[2], b[1], np.full(len(b[0]), -1), threshold).T
        # A pair that shares several clusters counts in the smallest of them alone.
        known = {c: k for k, c in enumerate(sorted({c for s in (a, b) for c in s[4].ravel().tolist() if c is not None}))}
        number = lambda s, filler: np.array([known.get(c, filler) for c in s[4].ravel().tolist()], np.int64).reshape(s[4].shape)
        x, y = np.nonzero(found)
        first = _first_common(number(a, -1)[x], number(b, -2)[y]) == known[cell]
        counted = np.zeros_like(found)
        counted[x[first], y[first]] = True
        # Local components: the smallest id that flows along links.
        ra, rb = a[0].copy(), b[0].copy()
        top = np.iinfo(np.int64).max
        while True:
            na = np.minimum(ra, np.where(found, rb[None, :], top).min(1))
            nb = np.minimum(rb, np.where(found, na[:, None], top).min(0))
            if i == j:
                na = nb = np.minimum(na, nb)
            if (na == ra).all() and (nb == rb).all():
                break
            ra, rb = na, nb
        ids, links, roots = [a[0]], [counted @ b[3]], [ra]
        if i != j:
            ids, links, roots = [*ids, b[0]], [*links, counted.T @ a[3]], [*roots, rb]
        ids, links, roots = (np.concatenate(z).astype(np.int64) for z in (ids, links, roots))
        some = (links > 0) | (roots != ids)
        return pa.table({"id": ids[some], "links": links[some], "root": roots[some]})

    return run


class _TrueLinks:
    """For each asked row, how many rows of (id, label, v, copies) link with it: all of them are compared."""

    def __init__(self, asked: list, threshold: float):
        self.threshold, self.by = threshold, {}
        for r in asked:
            self.by.setdefault((r["label"], len(r["v"])), []).append((r["id"], r["v"]))

    def __call__(self, batches):
        by = {k: (np.array([i for i, _ in rows]), np.array([v for _, v in rows])) for k, rows in self.by.items()}
        for batch in batches:
            ids, labels, copies = (batch.column(c).to_numpy() for c in ("id", "label", "copies"))
            sizes = batch.column("v").value_lengths().to_numpy()
            flat, starts = batch.column("v").flatten().to_numpy(), np.cumsum(sizes) - sizes
            out = []
            for (label, dim), (asked, q) in by.items():
                rows = np.flatnonzero((labels == label) & (sizes == dim))
                if len(rows):
                    near = (flat[starts[rows][:, None] + np.arange(dim)] @ q.T >= self.threshold) & (ids[rows][:, None] != asked[None, :])
                    out.append((asked, copies[rows] @ near))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k in (0, 1)], ["q", "true"])


def audit(reps: DataFrame, links: DataFrame, threshold: float, queries: int) -> tuple[float | None, int]:
    """(recall, true links) of at most queries representatives, against brute force over all of their label.

    Half of the queries are the first by hash of those that links were found for, half of all. Without a
    true link among them there is no recall: None.
    """
    order = F.xxhash64("id", F.lit("audit"))
    known = reps.join(links, "id", "left").select("id", "label", "v", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    some = known.where("links > 0").orderBy(order).limit(queries // 2).collect() + known.orderBy(order).limit(queries - queries // 2).collect()
    asked = {r["id"]: r for r in some}
    true = reps.select("id", "label", "v", "copies").mapInArrow(_TrueLinks(list(asked.values()), threshold), "q long, true long").groupBy("q").agg(F.sum("true").alias("true"))
    rows = true.collect()  # one for each query at most
    total = sum(r["true"] for r in rows)
    return (sum(min(r["true"], asked[r["q"]]["links"]) for r in rows) / total if total else None), total


def near_duplicates(
    vectors: DataFrame, *, id_col="vec_id", vector_col="embedding", label_col="label", threshold=0.93, shard_rows=64, part_rows=1024, margin=0.07, overlap=8,
    audit_queries=200, least_recall=0.9, report: dict | None = None,
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept.

    Vectors link if their labels are equal and not null and their cosine in double
    precision reaches threshold; component_id is the smallest id reachable by links
    that were found, itself included, and kept says that it is the row's own.
    Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do rows with a null id; vectors of different lengths do not link.
    Rows that repeat an id or a vector count each.

    The index holds every row. A row goes to the clusters of all centres whose cosine is within
    margin of its best, at most overlap; shard_rows is about how many rows a centre
    stands for. The links are audited (see audit()); while the recall is below least_recall they are
    searched for again with twice the overlap and half as much margin again. report gets
    recall (None without true links), true_links and overlap.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"))
    largest = F.array_max(F.transform("v", F.abs))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(odd, F.lit(True)) & (F.coalesce(largest, F.lit(0.0)) > 0)
    # Scaled by the largest component first, so that no square over- or underflows.
    divided = lambda x, by: F.zip_with(x, F.array_repeat(by, F.size(x)), lambda a, b: a / b)
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x))
    unit = rows.where(fit).withColumn("s", divided(F.col("v"), largest)).withColumn("v", divided(F.col("s"), norm)).drop("s")
    unit = staged(unit, "units")
    reps = staged(unit.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "reps")
    start = reps.select("id", "copies", "v", F.xxhash64("label", F.size("v")).alias("cell"))
    while True:
        members = staged(clusters(start, shard_rows, part_rows, margin, overlap), "members")
        sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
        cut = members.join(sizes, "cell").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
        graph = cut.select("id", "v", "cell", "sub").groupBy("cell", "sub").applyInArrow(lambda t: _build(t), "id long, cell long, near array<long>")
        graph = graph.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_set("cell").alias("cells"))
        tiles = cut.join(graph, "id").withColumn("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("sub", "t")).withColumn("j", F.greatest("sub", "t"))
        searched = staged(tiles.groupBy("cell", "i", "j").applyInArrow(_search(threshold), "id long, links long, root long"), "links")
        links = searched.groupBy("id").agg(F.sum("links").alias("links"))
        recall, true = audit(reps, links, threshold, audit_queries)
        if report is not None:
            report.update(recall=recall, true_links=true, overlap=overlap)
        if recall is None or recall >= least_recall or overlap >= 16 * DEGREE:
            break
        margin, overlap = 1.5 * margin, 2 * overlap
    found = components(searched.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_rep = reps.join(links, "id", "left").join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left").select(
        F.col("label").alias("l"), F.col("v").alias("w"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    # Back to the rows by their representative's label and vector.
    found = unit.join(of_rep, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "n_links", "component_id")
    alone = rows.where(~fit).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionAll(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
