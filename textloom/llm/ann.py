"""Approximate nearest neighbours by inner product: inverted lists scanned with adaptive dimensions.

Vectors get one more component so that the largest inner product is the smallest distance (all then have one length),
and a rotation into the principal axes of the differences between queries and rows, so the first columns tell most.
Centroids are fitted by k-means on a bounded sample: as many lists as the root of the number of rows, at every size, until
the sample of MAX_SAMPLE rows allows no more (PER_LIST rows for each list). Every vector goes to its nearest list and
every query probes its nearest lists: as many as held a share RECALL of the true neighbours of TRIALS sample rows, found by
brute force in the sample (and more, if those hold too few rows). Inside a list distances are summed
over blocks of columns. After each block a hypothesis test abandons candidates early: that a candidate is no farther than
the k-th best found is rejected if its distance over the columns seen, and what the columns to come add at least, exceed the
bound. The least addition belongs to the query and the list: the mean of what those columns add for the candidates
that look best after the first block, less DEVIATIONS standard deviations, or their least if that is less (and never below 0). What all candidates have in common, as a
query far from all rows or rows that are short beside one very long one, is thereby no reason to abandon any. The bound is the smallest one of the
k-th distance found in earlier rounds, that among the candidates that look best in the list, and that among ANCHORS rows of the sample in the
probed lists; the last two SPARE places further down, so that a wrong rejection doesn't shorten a result. Survivors are scored
exactly, in double precision on the original vectors. A query that is left with fewer rows than k, though there are as many, is
scanned again in its lists without tests or bounds.

A query's lists are scanned in rounds, nearest first: one list, then up to ROUND times as many lists in all with each round.
A round starts from the best k rows of those before, and a list gives nothing that is farther than the last of them: a few
times k rows for each round of a query, however many rows a list or the table has.

Lists and queries meet in tiles of at most about TILE_ROWS rows by TILE_QUERIES queries, so no list, however
large, is gathered in one task. Nothing but the sample (SAMPLE_BYTES at most), the centroids and the lists' sizes (one number for each list)
reaches the driver, in each round.

Defined cases: null or zero vectors, vectors with null or non-finite components, vectors of another dimension than most
rows (of equals the smallest), and rows without an id take no part. Repeated ids count as one row (the smallest vector by its order). A
query never finds its own id. Ties go to the smaller vec_id. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise, tidy

SAMPLE, MAX_SAMPLE, PER_LIST, RECALL, TRIALS, ANCHORS, K, DEVIATIONS, BLOCKS = 20_000, 100_000, 16, 0.97, 256, 2_000, 20, 4.0, (8, 16, 24, 32, 48)
SAMPLE_BYTES = 128 << 20
TILE_ROWS, TILE_QUERIES, ITERATIONS, SEED, FEW, SEEDS, SPARE, ROUND = 65_536, 16_384, 12, 11, 0.15, 4, 6, 4


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) of the rows that take part, each id once."""
    v = F.col(vector).cast("array<double>")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.col("vec_id").isNotNull() & sound).select("vec_id", v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, dimension: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _lengths(dimension: int):
    """How many vectors there are and the longest one's length, batch by batch; squares of very long ones aren't out of range."""

    def lengths(batches):
        for batch in (b for b in batches if b.num_rows):
            v = _matrix(batch.column("v"), dimension)
            top = np.abs(v).max(1)
            yield pa.RecordBatch.from_pydict({"n": [len(v)], "longest": [float((top * np.linalg.norm(v / top[:, None], axis=1)).max())]})

    return lengths


class Space:
    """The added component, the rotation, the lists' centroids, and what bounds need."""

    def __init__(self, dimension: int, longest: float, rotation: np.ndarray, centroids: np.ndarray):
        self.dimension, self.longest, self.rotation, self.centroids = dimension, longest, rotation, centroids
        self.anchors = np.zeros((0, dimension + 1), np.float32)

    @classmethod
    def fit(cls, sample: np.ndarray, longest: float, n_lists: int) -> Space:
        draws = np.random.default_rng(SEED)
        dimension = sample.shape[1]
        space = cls(dimension, longest, np.eye(dimension + 1, dtype=np.float32), np.zeros((1, dimension + 1), np.float32))
        rows, asked = space.rows(sample).astype(float), space.queries(sample).astype(float)
        gap = rows.mean(0) - asked.mean(0)
        centred = [x - x.mean(0) for x in (rows, asked)]
        spread = sum(x.T @ x for x in centred) / len(sample) + np.outer(gap, gap)  # second moments of the differences
        space.rotation = np.ascontiguousarray(np.linalg.eigh(spread)[1][:, ::-1].astype(np.float32))
        points = space.rows(sample)
        centroids = points[draws.choice(len(points), min(n_lists, len(points)), replace=False)]
        for _ in range(ITERATIONS):
            near = space.nearest(points, centroids)
            n = np.bincount(near, minlength=len(centroids))
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, points)
            centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        space.centroids = centroids.astype(np.float32)
        space.anchors = points[:ANCHORS]
        return space

    def trial(self, sample: np.ndarray, k: int, recall: float) -> int:
        """How many lists hold the share `recall` of the true neighbours of the sample's first rows."""
        points, asked = self.rows(sample), self.queries(sample[:TRIALS])
        scores = sample[:TRIALS] @ (sample / self.longest).T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        true = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        if not true.size:
            return 1
        order = self.order(asked)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
        return int(np.quantile(np.take_along_axis(place, self.nearest(points, self.centroids)[true], 1), recall)) + 1

    def bound(self, queries: np.ndarray, k: int, probed: np.ndarray | None = None) -> np.ndarray:
        """The distance of the k-th nearest anchor in the probed lists (a row of booleans for each query): no less than that of
        the k-th nearest row there; infinite where they hold fewer."""
        if len(self.anchors) < k:
            return np.full(len(queries), np.inf)
        own, out = self.nearest(self.anchors, self.centroids), []
        for a in range(0, len(queries), 1024):
            far = _distances(queries[a : a + 1024], self.anchors)
            if probed is not None:
                far[~probed[a : a + 1024][:, own]] = np.inf
            out.append(np.partition(far, k - 1, axis=1)[:, k - 1])
        return np.concatenate([*out, np.zeros(0)])

    def order(self, queries: np.ndarray) -> np.ndarray:
        """The lists of each query, nearest first."""
        return np.argsort((self.centroids**2).sum(1)[None] - 2 * queries @ self.centroids.T, axis=1, kind="stable")

    @staticmethod
    def nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        half = (centroids * centroids).sum(1) / 2
        return np.concatenate([(points[a : a + 4096] @ centroids.T - half).argmax(1) for a in range(0, len(points), 4096)]) if len(points) else np.zeros(0, np.int64)

    def rows(self, v: np.ndarray) -> np.ndarray:
        u = v / self.longest
        rest = np.sqrt(np.maximum(1 - (u * u).sum(1), 0))
        return np.hstack([u, rest[:, None]]).astype(np.float32) @ self.rotation

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Scaled to length one: a query's length doesn't change its order of neighbours."""
        u = v / np.abs(v).max(1, keepdims=True)  # the squares of neither very long nor very short ones are out of range
        unit = u / np.linalg.norm(u, axis=1, keepdims=True)
        return np.hstack([unit, np.zeros((len(v), 1))]).astype(np.float32) @ self.rotation


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; rounding may bring them a little below 0."""
    return (rows**2).sum(1)[None] + (queries**2).sum(1)[:, None] - 2 * queries @ rows.T


def scan(rows: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None, tests: np.ndarray | None = None, blocks=BLOCKS) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, row) that survive the adaptive scan: with them are the k nearest rows of each query; and the columns summed.

    bounds: what each query's k-th distance doesn't exceed anyway. tests: for which queries candidates are abandoned by test (all);
    for the others a candidate goes only once its distance so far exceeds the bound, which is never wrong. While many candidates live, a block's part of all
    distances is one matrix product (of the rows that still live for any query); once fewer than FEW do, only theirs are computed.
    """
    d, n = rows.shape[1], len(rows)
    ends = [b for b in blocks if b < d] + [d]
    so_far, work = _distances(queries[:, : ends[0]], rows[:, : ends[0]]), len(queries) * n * ends[0]
    bound = np.full(len(queries), np.inf) if bounds is None else bounds.astype(float)
    to_come = np.zeros((len(queries), len(ends)))  # by query and block: what the columns behind it add at least
    if n > k:
        few = min(n, SEEDS * k)
        seeds = np.argpartition(so_far, few - 1, axis=1)[:, :few]
        upto = np.add.reduceat((rows[seeds] - queries[:, None]) ** 2, [0, *ends[:-1]], axis=2).cumsum(2)
        whole = upto[:, :, -1]
        last = min(few, k + SPARE) - 1
        bound = np.minimum(bound, np.partition(whole, last, axis=1)[:, last])
        rest = whole[:, :, None] - upto
        to_come = np.maximum(np.minimum(rest.min(1), rest.mean(1) - DEVIATIONS * rest.std(1)), 0)
        if tests is not None:
            to_come[~tests] = 0
    bound = bound * (1 + 1e-4) + 1e-5  # no less than the k-th distance, for all rounding
    limits = bound[:, None] - to_come + 1e-5
    alive = so_far <= limits[:, :1]
    done, live = ends[0], np.arange(n)
    while done < d and (left := np.count_nonzero(alive)) and left > FEW * alive.size:
        some = alive.any(0)
        if not some.all():
            live, so_far, alive = live[some], so_far[:, some], alive[:, some]
        at = ends.index(done) + 1
        so_far = so_far + _distances(queries[:, done : ends[at]], rows[live, done : ends[at]])
        work += so_far.size * (ends[at] - done)
        alive &= so_far <= limits[:, at, None]
        done = ends[at]
    q, r = np.nonzero(alive)
    so_far, r = so_far[q, r], live[r]
    for at, (start, end) in enumerate(zip(ends, ends[1:], strict=False), 1):
        if start >= done:
            work += len(q) * (end - start)
            so_far = so_far + ((rows[r, start:end] - queries[q, start:end]) ** 2).sum(1)
            on = so_far <= limits[q, at]
            q, r, so_far = q[on], r[on], so_far[on]
    return q, r, work


def search(embeddings: DataFrame, every: int = 20, k: int = K, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id divisible by `every`) among all other rows.

    recall: the share of true neighbours that the probed lists are to hold, by trial on the sample.
    """
    spark = embeddings.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    taking = materialise(usable(embeddings))
    most = taking.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if most is None:
        return spark.createDataFrame([], schema)
    dimension = most["size"]
    points = taking.where(F.size("v") == dimension)
    total, longest = points.mapInArrow(tidy(_lengths(dimension)), "n long, longest double").agg(F.sum("n"), F.max("longest")).first()
    lists = max(1, int(np.sqrt(total)))
    wanted = max(1, min(MAX_SAMPLE, max(SAMPLE, PER_LIST * lists), SAMPLE_BYTES // (8 * dimension)))
    sample = _matrix(points.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(wanted).select("v").toArrow()["v"], dimension)
    space = Space.fit(sample, min(longest, 1e308), min(lists, max(1, min(MAX_SAMPLE, SAMPLE_BYTES // (8 * dimension)) // PER_LIST)))

    def listed(batches):
        for batch in batches:
            near = space.nearest(space.rows(_matrix(batch.column("v"), dimension)), space.centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=["vec_id", "v", "list"])

    rows = materialise(points.mapInArrow(listed, "vec_id long, v array<double>, list int"))
    n_lists = len(space.centroids)
    held = np.zeros(n_lists, np.int64)
    for r in rows.groupBy("list").count().collect():
        held[r["list"]] = r["count"]
    least = space.trial(sample, k, recall)

    def probed(batches):
        for batch in batches:
            v = _matrix(batch.column("v"), dimension)
            q = space.queries(v)
            order = space.order(q)
            enough = np.maximum(least, (held[order].cumsum(1) <= k + 1).sum(1) + 1)
            chosen = np.arange(n_lists)[None] < enough[:, None]
            inside = np.zeros_like(chosen)
            np.put_along_axis(inside, order, chosen, 1)
            bound = space.bound(q, k + 1 + SPARE, inside)
            ends = pa.array(np.concatenate(([0], np.cumsum(chosen.sum(1)))).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(order[chosen].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.linalg.norm(v, axis=1)), pa.array(bound.astype(float)), lists], names=["query_id", "v", "norm", "bound", "lists"])

    asked = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(probed, "query_id long, v array<double>, norm double, bound double, lists array<int>")
    asked = materialise(asked)
    ends = [1]
    while ends[-1] < n_lists:
        ends.append(ends[-1] * ROUND)
    turn = sum(((F.col("at") >= end).cast("int") for end in ends[:-1]), F.lit(0)).alias("turn")
    asking = [{} for _ in ends]  # how many queries each list has in each round
    for r in asked.select(F.posexplode("lists").alias("at", "list")).groupBy(turn, "list").count().collect():
        asking[r["turn"]][r["list"]] = r["count"]
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def tile(one: pa.Table, other: pa.Table) -> pa.Table:
        found: list = []
        if one.num_rows and other.num_rows:
            vectors, asks = _matrix(one["v"], dimension), _matrix(other["v"], dimension)
            ids, own, bounds, tests = one["vec_id"].to_numpy(), other["query_id"].to_numpy(), other["bound"].to_numpy(), other["tested"].to_numpy()
            turned, asked_ = space.rows(vectors), space.queries(asks)
            step = min(256, max(1, (1 << 22) // len(ids)))
            for at in range(0, len(own), step):
                q, r, _ = scan(turned, asked_[at : at + step], k + 1, bounds[at : at + step], tests[at : at + step])
                on = ids[r] != own[at + q]
                q, r = q[on] + at, r[on]
                score = np.concatenate([np.einsum("ij,ij->i", asks[q[a : a + 65536]], vectors[r[a : a + 65536]]) for a in range(0, len(q), 65536)] or [np.zeros(0)])
                order = np.lexsort((ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                start = np.searchsorted(q, q)
                top = np.arange(len(q)) - start < k
                found.append((own[q[top]], ids[r[top]], score[top]))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    def met(asking: DataFrame, queries: dict[int, int]) -> DataFrame:
        """What the tiles find for (query_id, v, bound, tested, list); queries: how many of them each list has."""
        cuts = spark.createDataFrame([(i, int(-(-held[i] // TILE_ROWS)) or 1, -(-n // TILE_QUERIES)) for i, n in queries.items()], "list int, rows_cut int, queries_cut int")
        cuts = F.broadcast(cuts)  # a row for each list, MAX_SAMPLE / PER_LIST at most
        left = rows.join(cuts, "list").select("vec_id", "v", "list", part("vec_id", "rows_cut").alias("a"), spread("queries_cut").alias("b"))
        right = asking.join(cuts, "list").select("query_id", "v", "bound", "tested", "list", spread("rows_cut").alias("a"), part("query_id", "queries_cut").alias("b"))
        return left.groupBy("list", "a", "b").cogroup(right.groupBy("list", "a", "b")).applyInArrow(tile, "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda near: near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found, start = None, 0
    for end, queries in zip(ends, asking, strict=True):
        if not queries:
            break
        bounded = asked
        if found is not None:
            last = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
            nearer = F.least("bound", F.lit(2.0) - F.try_divide(2 * F.col("least"), F.lit(space.longest) * F.col("norm")))  # the squared distance of that score
            bounded = asked.join(last, "query_id", "left").withColumn("bound", nearer)
        bounded = bounded.select("query_id", "v", "bound", F.lit(True).alias("tested"), F.explode(F.slice("lists", start + 1, end - start)).alias("list"))
        near = met(bounded, queries)
        before, start = found, end
        found = materialise(ranked(near if before is None else near.unionByName(before.drop("rank"))))
        if before is not None:
            discard(before)
    if found is None:
        found = spark.createDataFrame([], schema)
    else:
        whole = found.groupBy("query_id").count().where(F.col("count") >= min(k, total - 1)).select("query_id")
        short = materialise(asked.join(whole, "query_id", "left_anti").select("query_id", "v", F.lit(float("inf")).alias("bound"), F.lit(False).alias("tested"), F.explode("lists").alias("list")))
        if queries := {r["list"]: r["count"] for r in short.groupBy("list").count().collect()}:
            before, found = found, materialise(found.join(whole, "query_id").unionByName(ranked(met(short, queries))))
            discard(before)
        discard(short)
    for done in (taking, rows, asked):
        discard(done)
    return found.select("query_id", "rank", "vec_id", "score")
