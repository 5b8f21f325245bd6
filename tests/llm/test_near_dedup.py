import random
import re

import numpy as np
import pytest

from millrace.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=2):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs):
    sets = {}
    for i, t in docs:
        sets.setdefault(i, shingles(t))
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    seen = set()
    for group in holders.values():
        for x in range(len(group)):
            for y in range(x):
                a, b = group[y], group[x]
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= 80 * len(sets[a] | sets[b]) and root(a) != root(b):
                        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def got(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(N.op5_minhash(spark, sf)) == brute(docs)


def test_second_round_finds_what_stars_miss(spark, monkeypatch):
    """Families around a base, members of which link with few others; both ways of the second round."""
    rng = random.Random(5)
    docs, n = [], 1000
    for _ in range(6):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(40):
            words = list(base)
            for p in rng.sample(range(120), rng.randrange(3, 12)):
                words[p] = f"w{rng.randrange(10**6)}"
            docs.append((n, " ".join(words)))
            n -= 1
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert got(N.near_duplicates(df)) == want
    monkeypatch.setattr(N, "SMALL_BUCKET", 2)
    monkeypatch.setattr(N, "BLOCK", 8)
    assert got(N.near_duplicates(df)) == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = N.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_shingles"] == by[1]["n_shingles"] == by[2]["n_shingles"] == 0 and by[1]["kept"]
    assert by[3]["n_shingles"] == 1 and by[7]["component_id"] == 6 and not by[7]["kept"]
    assert N.near_duplicates(no_docs).count() == 0
    kept = N.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_repeated_and_null_keys_and_names(spark):
    """Rows that repeat a key with other texts are documents of their own; equal rows are one; columns may have any names."""
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(7, "one two three"), (7, "one two three"), (7, " ".join(base)), (3, near), (9, "one two three"), (None, near), (5, ""), (5, None), (4, "q " * 100_000 + "z")]
    df = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, h1 string, suspect string, n string").repartition(3)
    found = {(r["key"], r["n"], r["component_id"], r["first"]) for r in N.labelled(df).collect()}
    assert found == {(7, 2, 7, True), (9, 2, 7, True), (7, 59, 3, False), (3, 59, 3, True), (None, 59, None, True), (5, 0, 5, False), (4, 2, 4, True)}
    kept = N.deduplicated(df).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == sorted([(7, rows[0][1]), (3, near), (0, near), (5, ""), (5, ""), (4, rows[8][1])])
    assert all((r["h1"], r["suspect"], r["n"]) == ("a", "b", "c") for r in kept)


def test_hot_classes_and_components(spark, monkeypatch):
    """Joins that spread what many rows share give the same rows."""
    docs = [(i, "the same words in all of these") for i in range(40)] + [(100 + i, f"a b c d e f g h i j k {i}") for i in range(30)] + [(200 + i, f"alone {i} {i}") for i in range(9)]
    want = brute(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(N, "SAME", 3)
    assert got(N.near_duplicates(df)) == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    got = {r[0]: r[1] for r in N.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[101] == got[100] == 100


def test_components_take_no_round_to_confirm(spark, monkeypatch):
    """Edges that are stars are done; each round writes twice."""
    made, write = [], N.written
    monkeypatch.setattr(N, "written", lambda df, name, **o: made.append(name) or write(df, name, **o))
    for pairs, rounds in (([(1, 2), (1, 3), (5, 4), (4, 5)], 0), ([(1, 2), (2, 3)], 1), ([(2, 3), (1, 3)], 1)):
        made.clear()
        found = N.components(spark.createDataFrame(pairs, "u long, v long"))
        assert {tuple(r) for r in found.collect()} == {(x, 4 if x > 3 else 1) for p in pairs for x in p}
        assert len(made) == 1 + 2 * rounds


def test_bounds_of_shared_elements(monkeypatch):
    """Never below the exact number, equal to it where no positions collide, whatever the table's size."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 64, 4000, dtype="uint64")
    sets = [np.sort(rng.choice(base, n, replace=False)).view("int64") for n in (1, 40, 700, 3000)]
    exact = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for bits, at_once in (((16, 24), 1 << 20), ((16, 24), 100), ((4, 6), 50)):
        monkeypatch.setattr(N.Shared, "BITS", bits)
        monkeypatch.setattr(N.Shared, "AT_ONCE", at_once)
        shared = N.Shared(sets, sets)
        for k in range(4):
            most = shared.most(k, np.arange(4))
            assert (most >= exact[k]).all()
            may = shared.may_link(k, np.arange(4)[::-1], 80)[::-1]
            assert may[[100 * i >= 80 * (len(sets[k]) + len(x) - i) for i, x in zip(exact[k], sets, strict=True)]].all()
            if bits[0] == 16:
                assert (most <= exact[k] + 60).all() and may.tolist() == [m == k for m in range(4)]
    assert len(shared.most(0, np.array([], dtype="int64"))) == 0


def test_minima_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    m = N.Minima(N.BANDS * N.ROWS)
    for s in (0.5, 0.8):
        shared, n = int(1000 * 2 * s / (1 + s)), 1000
        est = []
        for _ in range(20):
            x = rng.integers(0, 2**63, size=2 * n - shared, dtype="uint64")
            est.append((m.of(x[:n]) == m.of(x[n - shared :])).mean())
        assert np.mean(est) == pytest.approx(s, abs=0.03)
