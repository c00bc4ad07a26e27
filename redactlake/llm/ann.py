"""Approximate nearest neighbours by inner product, with balanced posting lists.

Centroids come from a bounded sample by repeated splitting, so no list is much larger than others. Every vector goes
to its nearest centroid and, if it lies near a boundary, to further ones, unless these are closer to a centroid that
has it already. Centroids are found by best-first search in their neighbour graph, in memory. A query reads the lists
whose centroids are not much farther than the nearest ones, and as many as it needs to see enough candidates. How much
farther, and how many at most, is calibrated: vectors held out of the fit ask for their nearest ones in the sample, as
many as stand for k of the whole table, and both bounds are set so that COVERED of these lie in the lists read. So the
lists read follow from the data: few where vectors have structure, a third of the table where they have none.

Vectors are extended by one coordinate so that all have the norm of the longest one: then the nearest by distance are
those of the largest inner product. Lists are cut into blocks of bounded size on both sides, so neither a hot list nor
thousands of equal vectors meet in one task. Scores are computed from the original vectors in double precision, row by
row, so that equal vectors tie exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactlake.llm.common import Scratch

#: Vectors that centroids are fitted on, and the most centroids (lists grow beyond some 260,000 vectors).
SAMPLE, CENTROIDS = 32_768, 4096
#: Centroids for each root of the number of vectors, and the fewest sampled vectors for one.
PER_ROOT, PER_CENTROID = 8, 8
#: Vectors held out to calibrate with, and the share of their nearest ones that must be in the lists read.
PROBES, COVERED = 512, 0.94
#: Lists that hold a vector; how much farther than the nearest centroid these may be.
REPLICAS, NEAR = 4, 1.2
#: A further centroid is passed over if its squared distance to one that holds the vector is less than this share of that to the vector.
APART = 0.3
#: The fewest lists that a query reads.
LEAST_LISTS = 8
#: Neighbours in the centroid graph, and centroids held during a search.
DEGREE = 24
#: Vectors and queries of a list that meet in one group.
BLOCK = 8192


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray  # centroid x DEGREE
    entries: np.ndarray  # centroids a search begins at
    longest: float  # norm
    most: int = 1 << 30  # lists that a query reads
    reach: float = float("inf")  # how much farther than the LEAST_LISTS-th nearest centroid these may be


def extended(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", x, x), 0))
    return np.concatenate([x, rest[:, None]], 1) / longest


def extended_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))], 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared, of rows of unit length or shorter."""
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * a @ b.T, 0)


def _two_means(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of near equal size: along the difference of two centres, at the median."""
    centres = x[rng.choice(len(x), 2, replace=False)]
    side = np.arange(len(x)) % 2 == 0
    for _ in range(6):
        along = x @ (centres[1] - centres[0])
        new = along > np.median(along)
        if not 0.2 < new.mean() < 0.8:
            return side  # equal vectors
        if (new == side).all():
            break
        side = new
        centres = np.stack([x[~side].mean(0), x[side].mean(0)])
    return side


def fit(sample: np.ndarray, longest: float, wanted: int, seed: int = 0) -> Index:
    """sample: original vectors."""
    rng = np.random.default_rng(seed)
    x = extended(sample, longest)
    parts = [np.arange(len(x))]
    while len(parts) < wanted and max(map(len, parts)) > 3:
        parts.sort(key=len)
        part = parts.pop()
        side = _two_means(x[part], rng)
        parts += [part[side], part[~side]]
    c = np.stack([x[p].mean(0) for p in parts])
    for _ in range(3):  # a few rounds of Lloyd's
        of = np.concatenate([_distance(x[i : i + 1024], c).argmin(1) for i in range(0, len(x), 1024)])
        for k in range(len(c)):
            if (of == k).any():
                c[k] = x[of == k].mean(0)
    c = np.unique(c, axis=0)
    near = np.concatenate([np.argsort(_distance(c[i : i + 256], c), axis=1)[:, : DEGREE + 1] for i in range(0, len(c), 256)])
    graph = np.array([[j for j in row if j != i][:DEGREE] or [i] for i, row in enumerate(near)])
    # A few long links keep the graph in one piece.
    graph = np.concatenate([graph, rng.integers(0, len(c), (len(c), 4))], 1)
    return Index(c, graph, rng.choice(len(c), min(len(c), 32), replace=False), longest)


def search(index: Index, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest centroids found (fewer: -1) and their squared distances, for rows of q, by best-first search."""
    c, n = index.centroids, len(q)
    k = min(k, len(c))
    beam = max(k, DEGREE)
    ids = np.full((n, beam), -1)
    far = np.full((n, beam), np.inf)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, len(c)), bool)
    squares = np.einsum("ij,ij->i", c, c)
    own = np.einsum("ij,ij->i", q, q)
    new, rows = np.broadcast_to(index.entries, (n, len(index.entries))), np.arange(n)
    while len(rows):
        fresh = ~seen[rows[:, None], new]
        for col in range(1, new.shape[1]):  # the same centroid twice in a row of new
            fresh[:, col] &= (new[:, :col] != new[:, col, None]).all(1)
        seen[rows[:, None], new] = True
        d = own[rows, None] + squares[new] - 2 * np.einsum("ijk,ik->ij", c[new], q[rows])
        d = np.where(fresh, np.maximum(d, 0), np.inf)
        all_d = np.concatenate([far[rows], d], 1)
        all_i = np.concatenate([ids[rows], new], 1)
        all_done = np.concatenate([done[rows], ~fresh], 1)
        o = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        far[rows] = np.take_along_axis(all_d, o, 1)
        ids[rows] = np.take_along_axis(all_i, o, 1)
        done[rows] = np.take_along_axis(all_done, o, 1)
        rows = np.flatnonzero(~done.all(1))
        best = np.argmin(np.where(done[rows], np.inf, far[rows]), axis=1)
        done[rows, best] = True
        new = index.graph[ids[rows, best]]
    return np.where(np.isfinite(far[:, :k]), ids[:, :k], -1), far[:, :k]


def lists_of(index: Index, x: np.ndarray, replicas: int = REPLICAS, near: float = NEAR, apart: float = APART) -> list[list[int]]:
    """The lists that hold each vector, the nearest first."""
    ids, far = search(index, extended(x, index.longest), replicas * 3)
    between = index.centroids
    out = []
    for row, d in zip(ids, far, strict=True):
        held = [int(row[0])]
        for i, e in zip(row[1:], d[1:], strict=True):
            if i < 0 or e > near**2 * d[0] + 1e-12 or len(held) == replicas:
                break
            if all(((between[i] - between[h]) ** 2).sum() > apart * e for h in held):
                held.append(int(i))
        out.append(held)
    return out


def calibrated(index: Index, probes: np.ndarray, sample: np.ndarray, n: int, k: int, covered: float = COVERED) -> Index:
    """The index with its bounds for reading. probes: vectors that are not in the sample; n: vectors of the table."""
    wanted = min(max(1, -(-k * len(sample) // n)), len(sample))
    best = np.concatenate([np.argpartition(-(probes[i : i + 64] @ sample.T), wanted - 1, axis=1)[:, :wanted] for i in range(0, len(probes), 64)])
    rows, of = np.unique(best, return_inverse=True)
    held = lists_of(index, sample[rows])
    d = _distance(extended_query(probes), index.centroids)
    rank = np.empty(d.shape, "i8")
    np.put_along_axis(rank, np.argsort(d, axis=1), np.arange(d.shape[1])[None, :], axis=1)
    # Not the nearest one: a vector that its centroid was fitted on is nearer to that than others are to theirs.
    base = np.partition(d, min(LEAST_LISTS, d.shape[1]) - 1, axis=1)[:, min(LEAST_LISTS, d.shape[1]) - 1]
    ranks, ratios = [], []
    for p, own in enumerate(of.reshape(best.shape)):
        for v in own:
            first = min(held[v], key=lambda c: rank[p, c])
            ranks.append(rank[p, first])
            ratios.append(np.sqrt(d[p, first] / max(base[p], 1e-12)))
    index.most = int(np.quantile(ranks, 1 - (1 - covered) / 4, method="higher")) + 1
    index.reach = float(np.quantile(ratios, covered, method="higher"))
    return index


def lists_for(index: Index, q: np.ndarray, counts: np.ndarray, enough: int, least: int = LEAST_LISTS) -> list[list[int]]:
    """The lists each query reads. counts: vectors whose nearest centroid it is, so that `enough` are seen."""
    wide = extended_query(q)
    ids, far = search(index, wide, max(index.most, least))
    out = []
    for x, row, d in zip(wide, ids, far, strict=True):
        own, held, base = [], 0, d[min(least, len(d)) - 1]
        for i, e in zip(row, d, strict=True):
            if i < 0 or (len(own) >= least and e > index.reach**2 * base and held >= enough):
                break
            own.append(int(i))
            held += int(counts[i])
        if held < enough:  # further than the search has gone
            for i in np.argsort(((index.centroids - x) ** 2).sum(1)).tolist():
                if i not in own:
                    own.append(i)
                    held += int(counts[i])
                    if held >= enough:
                        break
        out.append(own)
    return out


def usable(vector: str) -> Column:
    """Whether a vector has entries, none null or not finite, not all zero."""
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(n, -1) if n else np.empty((0, 0))


def top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec, score) of each query's k best of the block; equal scores by the smaller id."""
    out: list[tuple] = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[q_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        for i in range(len(s)):
            row = s[i]
            if len(row) > k:
                bar = np.partition(row, -k)[-k]
                pick = np.flatnonzero(row >= bar - 1e-9 * (abs(bar) + 1)) if np.isfinite(bar) else np.flatnonzero(np.isfinite(row))
            else:
                pick = np.flatnonzero(np.isfinite(row))
            exact = (x[pick] * q[at + i]).sum(1)
            best = np.lexsort((ids[pick], -exact))[:k]
            out.append((np.full(len(best), q_ids[at + i]), ids[pick][best], exact[best]))
    if not out:
        return np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(df: DataFrame, every: int = 20, k: int = 20, vec: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, centroids: int = CENTROIDS, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by `every`, the k best among all other rows.

    Vectors that are null, zero, hold null or non-finite components or have no id take no part, nor do those whose
    number of components is not the commonest one. Rows that repeat an id are one candidate, with the better score.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = df.where(F.col(vec).isNotNull() & usable(vector)).select(F.col(vec).cast("long").alias("vec"), F.col(vector).alias("x"))
    dims = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v))).alias("longest")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("x") == dims["d"])
    found = _matrix(rows.orderBy(F.xxhash64("vec"), "vec").limit(sample).select("x").toArrow()["x"])
    held_out, longest = (PROBES if len(found) >= 4 * PROBES else 0), float(dims["longest"])
    wanted = int(np.clip(np.sqrt(dims["n"]) * PER_ROOT, 1, min(centroids, len(found) // PER_CENTROID + 1)))
    index = fit(found[held_out:], longest, wanted)
    if held_out:  # else every list is read
        index = calibrated(index, found[:held_out], found[held_out:], dims["n"], k)

    def assign(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                held = lists_of(index, _matrix(part.column(1)))
                of = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array([i for h in held for i in h], pa.int32()), pa.array([j == 0 for h in held for j in range(len(h))]), part.column(0).take(of), part.column(1).take(of)], names=["list", "main", "vec", "x"])

    kind = df.schema[vector].dataType.simpleString()
    postings = scratch.table(rows.mapInArrow(assign, f"list int, main boolean, vec long, x {kind}"), "postings")
    sizes, counts = np.ones(len(index.centroids), "i8"), np.zeros(len(index.centroids), "i8")
    for r in postings.groupBy("list").agg(F.count("*").alias("n"), F.count_if("main").alias("m")).collect():  # a row per centroid
        sizes[r["list"]], counts[r["list"]] = r["n"], r["m"]
    enough = 2 * k + 1

    def probe(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                held = lists_for(index, _matrix(part.column(1)), counts, enough)
                of = pa.array(np.repeat(np.arange(len(held)), [len(h) for h in held]))
                yield pa.RecordBatch.from_arrays([pa.array([i for h in held for i in h], pa.int32()), part.column(0).take(of), part.column(1).take(of)], names=["list", "vec", "x"])

    asked = scratch.table(rows.where(F.col("vec") % every == 0).mapInArrow(probe, f"list int, vec long, x {kind}"), "queries")
    asks = np.ones(len(index.centroids), "i8")
    for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row per centroid
        asks[r["list"]] = r["n"]
    cuts = spark.createDataFrame([(i, int(-(-a // block)), int(-(-b // block))) for i, (a, b) in enumerate(zip(sizes, asks, strict=True))], "list int, vs int, qs int")
    cut = lambda n: F.pmod(F.xxhash64("vec"), n).cast("int")
    # Blocks of a list's vectors meet blocks of its queries.
    left = postings.join(F.broadcast(cuts), "list").select("list", cut(F.col("vs")).alias("v"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "vec", "x")
    right = asked.join(F.broadcast(cuts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)).alias("v"), cut(F.col("qs")).alias("q"), "vec", "x")

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        got = top(_matrix(b.column("x")), b.column("vec").to_numpy(), _matrix(a.column("x")), a.column("vec").to_numpy(), k) if a.num_rows and b.num_rows else (np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))
        return pa.table({"query_id": got[0].astype("i8"), "vec_id": got[1].astype("i8"), "score": got[2]})

    keys = ["list", "v", "q"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")
    once = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return once.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
