"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Rows are dealt to parts of at most about ``PART_ROWS``, queries to blocks of at most about
``PART_QUERIES``; each block meets each part in one task, so a vector moves once for each
block of queries and no task holds more than a part and a block. In a task, each of ``TREES``
trees is a sorted array of 64-bit strings: signs of random projections, orthogonal in rounds,
whose bytes trees share in different orders (a tree's first byte is its own). A query descends
to its longest matching prefixes and ascends in all trees at once, a bit at a time, until the
subtrees it has reached hold its share of ``candidates(n)`` rows, counted once a tree; at the
last bit trees ascend one after another. Only rows of these subtrees are scored, in double
precision, and only a block's best ``k + 1`` ids of each part leave the task.

Vectors are extended by one component so that all of a range of norms have the range's largest
(a query by 0), which makes the angle order that of inner products. A part's rows of unlike
norms form several ranges, largest first; a range whose bound lies below a query's k-th best
so far is skipped, which loses nothing.

Equal vectors: of those in a part only the ``k + 1`` smallest ids can be among a query's best,
so only those are searched, and equal queries are searched once; both are exact.

Edge cases: null, empty and zero vectors and those with null or non-finite components take no
part, nor do null ids; lengths are searched apart; ties go to the smaller id; rows with an equal
id are one candidate for another, at the better score, and one query; with fewer than k others,
all are returned; a product that overflows is infinite, one of opposite infinities ranks last;
an empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import default_parallelism, release, table

TREES, BYTES, SEED, K = 256, 8, 23, 20
BITS = 8 * BYTES
#: A task holds at most about so many rows (4 KB each with their strings) and queries.
PART_ROWS, PART_QUERIES = 65_536, 8_192
#: A part smaller than this is not worth a task of its own.
LEAST_ROWS = 2_048
#: So few rows are all candidates.
FEW = 500
#: A range of norms ends where a norm falls below this share of its largest, and it holds so many rows.
NORM_SHARE, LEAST_RANGE = 0.85, 32
#: Queries of one vector that one task of the final join takes.
SAME = 10_000


def candidates(n: int) -> int:
    """Rows, counted once a tree, that a query's subtrees must hold among ``n``; measured for recall above 0.9. Of few rows, all."""
    return TREES * n if n <= FEW else math.ceil(3.5 * n**0.75 + 16 * n**0.5)


def planes(dim: int, trees: int = TREES) -> np.ndarray:
    """Directions, eight for each tree's own byte, orthogonal in rounds of ``dim``."""
    rng = np.random.default_rng([SEED, dim])
    rounds = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-8 * trees // dim))]
    return np.concatenate(rounds, axis=1)[:, : 8 * trees].astype("float32")


def strings(x: np.ndarray, trees: int = TREES) -> np.ndarray:
    """uint64 strings (trees, rows) of float32 rows: byte 0 is the tree's own, the others are other trees'."""
    p = planes(x.shape[1], trees)
    pool = np.concatenate([np.packbits(x[i : i + 4096] @ p > 0, axis=1) for i in range(0, len(x), 4096)] or [np.empty((0, trees), "u1")])
    rng = np.random.default_rng(SEED)
    out = np.empty((trees, len(x), BYTES), dtype="u1")
    for j in range(BYTES):
        out[:, :, j] = pool[:, rng.permutation(trees) if j else np.arange(trees)].T
    return out.view(">u8")[:, :, 0].astype("uint64")


class Forest:
    """Sorted strings of one range of rows; ``reach`` gives the places each query's subtrees hold."""

    def __init__(self, x: np.ndarray):
        """``x``: float32 rows, extended to equal norms."""
        s = strings(x)
        self.order = np.empty(s.shape, dtype="int32")
        for t in range(len(s)):
            self.order[t] = o = np.argsort(s[t])
            s[t] = s[t][o]
        self.strings = s

    def _held(self, q: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last-but-one places (trees, queries) of the subtrees at each query's level."""
        rest = np.where(level == 0, ~np.uint64(0), (np.uint64(1) << np.minimum(BITS - level, BITS - 1).astype("uint64")) - np.uint64(1))
        lo, hi = np.empty(q.shape, dtype="int32"), np.empty(q.shape, dtype="int32")
        for t in range(len(q)):
            lo[t] = np.searchsorted(self.strings[t], q[t] & ~rest, "left")
            hi[t] = np.searchsorted(self.strings[t], q[t] | rest, "right")
        return lo, hi

    def reach(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Places [lo, hi) (trees, queries) of the subtrees that hold at least ``want`` rows, counted once a tree, or all."""
        trees, m = self.strings.shape
        n = q.shape[1]
        level = np.full(n, min(BITS, max(0, round(math.log2(max(1.0, trees * m / max(1, want)))))), dtype="int64")
        lo, hi = self._held(q, level)
        held = (hi - lo).sum(axis=0)
        # the subtrees one bit deeper, which hold too few
        lo2, hi2 = lo.copy(), hi.copy()
        deeper = np.flatnonzero((held >= want) & (level < BITS))
        up = np.flatnonzero((held < want) & (level > 0))
        while len(deeper):
            a, b = self._held(q[:, deeper], level[deeper] + 1)
            lo2[:, deeper], hi2[:, deeper] = a, b
            go = (b - a).sum(axis=0) >= want
            lo[:, deeper[go]], hi[:, deeper[go]] = a[:, go], b[:, go]
            level[deeper[go]] += 1
            deeper = deeper[go][level[deeper[go]] < BITS]
        while len(up):
            lo2[:, up], hi2[:, up] = lo[:, up], hi[:, up]
            level[up] -= 1
            lo[:, up], hi[:, up] = self._held(q[:, up], level[up])
            few = (hi[:, up] - lo[:, up]).sum(axis=0) < want
            up = up[few & (level[up] > 0)]
        # trees ascend the last bit one after another until there are enough
        n1, n2 = (hi - lo).astype("int64"), (hi2 - lo2).astype("int64")
        holds = n1.cumsum(axis=0) + n2.sum(axis=0) - n2.cumsum(axis=0)
        last = np.where((holds >= want).any(axis=0), (holds >= want).argmax(axis=0), trees)
        stay = np.arange(trees)[:, None] > last
        return np.where(stay, lo2, lo), np.where(stay, hi2, hi)

    def marks(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Whether each query (of few) has each row among its candidates."""
        trees, m = self.strings.shape
        n = lo.shape[1]
        seen = np.zeros(n * m, dtype=bool)
        base = np.arange(n, dtype="int64") * m
        for t in range(trees):
            size = hi[t] - lo[t]
            ends = np.cumsum(size)
            at = np.arange(ends[-1], dtype="int64") + np.repeat(lo[t] - (ends - size), size)
            seen[self.order[t][at] + np.repeat(base, size)] = True
        return seen.reshape(n, m)


def _ranges(norm: np.ndarray):
    """Bounds of ranges of norms that descend."""
    i, least = 0, LEAST_RANGE
    while i < len(norm):
        j = max(i + least, int(np.searchsorted(-norm, -NORM_SHARE * norm[i], "right")))
        j = len(norm) if len(norm) - j < least else j
        yield i, j
        i = j


def _kept(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without repeats, of equal vectors only the k + 1 smallest ids."""
    rows = pd.DataFrame({"same": pd.factorize(pd.Series([r.tobytes() for r in x], dtype=object))[0], "id": ids}).drop_duplicates()
    return rows.index[rows.groupby("same").id.rank("first") <= k + 1].to_numpy()


def best(ids: np.ndarray, x: np.ndarray, asked: np.ndarray, n: int, k: int, want: Callable[[int], int] = candidates):
    """For each query vector, (ids, scores) of the best k + 1 ids found, best first, ties to smaller ids.

    ``n``: rows of the whole table, of which these are a random part. A range of norms that holds a
    share of the part stands for that share of the table, and must give its share of what the stop
    rule ``want`` asks of a table of that size.
    """
    whole = n / max(1, len(ids))
    keep = _kept(ids, x, k)
    x = x[keep] + 0.0
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        top = np.abs(x).max(axis=1)
        norm = top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))
        down = np.argsort(-norm, kind="stable")
        ids, x, norm = ids[keep][down], x[down], norm[down]
        size = np.abs(asked).max(axis=1)
        length = size * np.sqrt(((asked / size[:, None]) ** 2).sum(axis=1))
        q = strings(np.column_stack([asked / length[:, None], np.zeros(len(asked))]).astype("float32"))
        # a product and the sum in order differ by less than half of this
        slack = 4 * x.shape[1] * np.finfo("float64").eps * length * norm[0]
        repeats = len(np.unique(ids)) < len(ids)
        found = [(np.empty(0, "int64"), np.empty(0)) for _ in asked]
        edge = np.full(len(asked), -np.inf)
        for i, j in _ranges(norm):
            own = x[i:j] / norm[i]
            rest = np.sqrt(np.maximum(0.0, 1.0 - (own * own).sum(axis=1)))
            forest = Forest(np.column_stack([own, rest]).astype("float32"))
            active = np.flatnonzero(~(edge > length * norm[i] + slack))
            step = max(1, min(512, (16 << 20) // (j - i)))
            for a in range(0, len(active), step):
                some = active[a : a + step]
                seen = forest.marks(*forest.reach(q[:, some], math.ceil(want(round(whole * (j - i))) / whole)))
                for r, mark in zip(some.tolist(), seen, strict=True):
                    at = i + np.flatnonzero(mark)
                    v = x[at] @ asked[r]
                    if len(found[r][0]):
                        at, v = np.concatenate([found[r][0], at]), np.concatenate([found[r][1], v])
                    if len(v) > k + 1 and not repeats and np.isfinite(v).all():
                        edge[r] = np.partition(v, len(v) - k - 1)[len(v) - k - 1]
                        near = v >= edge[r] - slack[r]
                        at, v = at[near], v[near]
                    found[r] = (at, v)
        for r, (at, _) in enumerate(found):
            if len(at) <= k < len(ids):  # subtrees that hold the same few rows again and again
                at = np.arange(len(ids))
            # ties exactly: the same sum in order wherever a pair meets
            v = np.cumsum(x[at] * asked[r], axis=1)[:, -1] + 0.0 if len(at) else np.empty(0)
            v = np.where(np.isnan(v), -np.inf, v)
            first = np.lexsort((ids[at], -v))
            if repeats:
                first = first[np.sort(np.unique(ids[at][first], return_index=True)[1])]
            first = first[: k + 1]
            yield ids[at][first], v[first]


def _valid(v: str) -> Column:
    x = F.col(v)
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))


def _dense(t: pa.Table) -> np.ndarray:
    return t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(t.num_rows, -1)


def nearest(rows: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K, want: Callable[[int], int] = candidates) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows nearest to each row for which ``queries`` (a condition) holds."""
    spark = rows.sparkSession
    asks = F.coalesce(queries, F.lit(False))
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("x"), asks.alias("query")).where(_valid("x") & F.col("id").isNotNull()).withColumn("dim", F.size("x"))
    n, m = (int(v or 0) for v in valid.agg(F.count(F.lit(1)), F.count_if("query")).first())
    parts = max(1, math.ceil(n / PART_ROWS), min(default_parallelism(spark), n // LEAST_ROWS))
    blocks = max(1, math.ceil(m / PART_QUERIES))

    # a query vector is named by two hashes; equal ones are one
    same = ["dim", "c1", "c2"]
    plain = F.transform("x", lambda c: c.cast("double") + 0.0)
    named = valid.where("query").withColumns({"c1": F.xxhash64(plain), "c2": F.xxhash64(F.lit(SEED), plain)})
    asked = named.groupBy(*same).agg(F.first("x").alias("x"))
    block = F.pmod("c1", F.lit(blocks)).cast("int")
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    none = F.lit(None).cast("long")
    left = valid.select("dim", place.alias("i"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("j"), "id", none.alias("c1"), none.alias("c2"), "x")
    right = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i"), block.alias("j"), none.alias("id"), "c1", "c2", "x")

    def search(t: pa.Table) -> pa.Table:
        try:
            own, ask = t.filter(t["id"].is_valid()), t.filter(t["id"].is_null())
            out = list(best(own["id"].to_numpy(), _dense(own), _dense(ask), n, k, want)) if own.num_rows and ask.num_rows else []
            ids, scores = pa.array([o[0] for o in out], pa.list_(pa.int64())), pa.array([o[1] for o in out], pa.list_(pa.float64()))
            return pa.table([*(ask[c] if out else ask[c].slice(0, 0) for c in same), ids, scores], names=[*same, "ids", "scores"])
        finally:
            release()

    both = left.unionByName(right).repartition(parts * blocks, "dim", "i", "j")
    found = both.groupBy("dim", "i", "j").applyInArrow(search, "dim int, c1 long, c2 long, ids array<long>, scores array<double>")
    pairs = found.select(*same, F.explode(F.arrays_zip("ids", "scores")).alias("p")).select(*same, F.col("p.ids").alias("vec_id"), F.col("p.scores").alias("score"))
    pairs = pairs.groupBy(*same, "vec_id").agg(F.max("score").alias("score"))
    order = [F.desc("score"), "vec_id"]
    top = pairs.withColumn("rank", F.row_number().over(W.partitionBy(*same).orderBy(*order))).where(F.col("rank") <= k + 1)
    answers = top.groupBy(*same).agg(F.collect_list(F.struct("score", "vec_id")).alias("best"))

    # members of a vector that many queries share meet its answer in several tasks; at most 1,000 vectors are so common
    members = named.select(F.col("id").alias("query_id"), *same).distinct()
    limit = max(SAME, m // 1000)
    hot = F.broadcast(members.groupBy(*same).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select(*same, F.ceil(F.col("c") / limit).cast("int").alias("g")))
    g = F.coalesce("g", F.lit(1))
    members = members.join(hot, same, "left").withColumn("s", F.pmod(F.xxhash64("query_id"), g).cast("int")).drop("g")
    answers = answers.join(hot, same, "left").withColumn("s", F.explode(F.sequence(F.lit(0), g - 1))).drop("g")
    each = members.join(answers, [*same, "s"]).select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score").where("vec_id <> query_id")
    each = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
