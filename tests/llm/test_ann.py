import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann as A


def brute(rows, asked, k=20):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype="float64")
    out = {}
    for i in np.flatnonzero([asked(v) for v in ids]):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def results(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / len(want[q]) for q in want])


def test_query_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    got, want = results(A.op2_prefix_forest(spark, sf)), brute(rows, lambda v: v % 20 == 0)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, v): s for q in want for v, s in want[q]}
    for q in got:
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True) and len(got[q]) == 20
        assert all(s == pytest.approx(exact[q, v], abs=1e-12) for v, s in got[q] if (q, v) in exact)


def test_norms_matter_levels_vary_and_parts_meet(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 150)
    monkeypatch.setattr(A, "PART_QUERIES", 10)
    monkeypatch.setattr(A, "SAME", 3)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 16)) * rng.lognormal(0, 0.5, size=(900, 1))
    x[:300] = x[0] + rng.normal(size=(300, 16)) * 0.01  # a dense cluster
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = results(A.nearest(df, F.col("vec_id") % 20 == 0)), brute(rows, lambda v: v % 20 == 0)
    assert recall(got, want) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [None, 1.0]), (7, [2.0, 1.0]), (8, [2.0, 1.0]), (9, [-1.0, 0.5]), (20, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit(1))
    got = results(A.nearest(df, F.col("vec_id") % 20 == 0))
    assert got == {0: [(7, 2.0), (8, 2.0), (20, 0.0), (9, -1.0)], 20: [(7, 3.0), (8, 3.0), (9, 1.5), (0, 0.0)]}
    assert A.nearest(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize(("n", "sigma", "most"), [(2_000, 0.0, 0.6), (100_000, 0.0, 0.21), (100_000, 0.5, 0.35), (100_000, 1.0, 0.2)])
def test_recall_without_structure(n, sigma, most, monkeypatch):
    """The tasks' part alone, in parts, with the production stop rule: recall, and the share of rows that are scored."""
    rng, m, part = np.random.default_rng(8), 60, 16_384
    x = rng.normal(size=(n, 64))
    x *= (rng.lognormal(0, sigma, size=n) / np.linalg.norm(x, axis=1))[:, None]
    s = x[:m] @ x.T
    s[np.arange(m), np.arange(m)] = -np.inf
    want = np.argpartition(-s, 20, axis=1)[:, :20]
    scored, marks = [], A.Forest.marks

    def counted(self, lo, hi):
        seen = marks(self, lo, hi)
        scored.append(seen.sum())
        return seen

    monkeypatch.setattr(A.Forest, "marks", counted)
    got = [[] for _ in range(m)]
    for a in range(0, n, part):
        for r, (ids, v) in enumerate(A.best(np.arange(a, min(n, a + part)), x[a : a + part], x[:m], n, 20)):
            got[r] += zip(-v, ids, strict=True)
    found = [{i for _, i in sorted(g)[:21] if i != r} for r, g in enumerate(got)]
    assert np.mean([len(f & set(w.tolist())) / 20 for f, w in zip(found, want, strict=True)]) >= 0.9
    assert sum(scored) / m / n <= most


def test_reach_is_synchronous_ascent():
    """Subtrees hold enough rows, no more than the last tree's last bit beyond it, and every tree is at one of two levels."""
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(3000, 17)).astype("float32"), rng.normal(size=(9, 17)).astype("float32")
    forest, asked = A.Forest(x), A.strings(q)
    own = A.strings(x)
    for want in (1, 700, 20_000, 10**9):
        lo, hi = forest.reach(asked, want)
        for j in range(len(q)):
            level = [next(b for b in range(A.BITS, -1, -1) if np.sum(own[t] >> np.uint64(A.BITS - b) == asked[t, j] >> np.uint64(A.BITS - b)) == hi[t, j] - lo[t, j] or b == 0) if hi[t, j] > lo[t, j] else A.BITS for t in range(0, A.TREES, 16)]
            assert (hi - lo)[:, j].sum() >= min(want, A.TREES * len(x))
            if want == 10**9:
                assert set(level) == {0} or (hi - lo)[:, j].sum() == A.TREES * len(x)
            if want == 700:
                assert (hi - lo)[:, j].sum() <= 2 * want


def test_equal_vectors_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 333)
    monkeypatch.setattr(A, "PART_QUERIES", 7)
    monkeypatch.setattr(A, "SAME", 9)
    x = np.random.default_rng(5).normal(size=64).tolist()
    df = spark.createDataFrame([(i, x) for i in range(2000)], "vec_id long, embedding array<double>")
    got = results(A.nearest(df, F.col("vec_id") % 20 == 0))
    assert len(got) == 100
    for q, best in got.items():
        assert [v for v, _ in best] == [i for i in range(21) if i != q][:20]
        assert len({s for _, s in best}) == 1


def test_ties_of_unlike_vectors_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ROWS", 40)
    rng = np.random.default_rng(6)
    rows = [(0, [2.0, 0.0, 0.0])] + [(i, [1.0, *map(float, rng.normal(size=2))]) for i in range(1, 201)]
    rows += [(7, [1.5, 0.0, float(j)]) for j in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(A.nearest(df, F.col("vec_id") == 0, want=lambda n: 10**9))
    assert got[0] == [(7, 3.0)] + [(i, 2.0) for i in range(1, 21) if i != 7]


def test_overflow_and_tiny(spark):
    rows = [(0, [1e200, 1e200]), (20, [1e-200, 0.0]), (1, [1e200, -1e200]), (2, [1.0, 1.0]), (3, [3e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(A.nearest(df, F.col("vec_id") % 20 == 0))
    assert [v for v, _ in got[0]] == [3, 2, 20, 1] and got[0][0][1] == float("inf") and got[0][-1][1] == float("-inf")
    assert [v for v, _ in got[20]] == [3, 0, 1, 2]
