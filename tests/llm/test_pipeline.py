import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from millrace.llm import langid as L

from .test_langid import brute_fit, brute_shares, folded
from .test_mixing import WORD, brute_targets
from .test_near_dedup import brute, shingles


@pytest.fixture(scope="module")
def kept(spark, sf):
    """Each stage's rows."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in P.STAGES:
        docs = P.written(stage(spark, docs, sf), f"test-{name}")
        out.append(docs)
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(kept):
    assert all(d.columns == kept[0].columns for d in kept[1:5])


def test_language_stage_by_brute_force(spark, sf, kept, odd_docs):
    """A row stays where it has letters and a language holds enough of its n-grams, by plain sets of strings."""
    before = rows(kept[0])
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    sets = brute_fit([(r["lang"], r["text"]) for r in before if not held(r["doc_id"])], L.SAMPLE, L.PROFILE)
    after = {r["doc_id"] for r in rows(kept[1])}
    for r in before:
        share = max(brute_shares(r["text"], sets).values()) if len(folded(r["text"] or "")) > 1 else 0
        if abs(share - P.LEAST_SHARE) > 0.02:
            assert (r["doc_id"] in after) == (share >= P.LEAST_SHARE), (r["doc_id"], share)
    got = {r["doc_id"] for r in rows(P.identify_language(spark, odd_docs, ""))}
    assert got >= {6, 7} and not got & {0, 1, 2}


def test_dedup_stage(kept):
    before, after = rows(kept[1]), {r["doc_id"] for r in rows(kept[2])}
    from . import test_near_dedup as T

    old = T.shingles
    T.shingles = lambda t, k=5: old(t, 5)
    try:
        groups = brute([(r["doc_id"], r["text"]) for r in before])
    finally:
        T.shingles = old
    assert after == {i for i, (_, c) in groups.items() if i == c}


def test_secret_stage(kept):
    before, after = {r["doc_id"]: r for r in rows(kept[2])}, {r["doc_id"]: r for r in rows(kept[3])}
    assert set(before) == set(after)
    for i, r in after.items():
        assert r["text"] == before[i]["text"] or ("<secret>" in r["text"] and r["n_chars"] == len(r["text"]))
        assert not re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r["text"])


def test_mixing_stage(kept):
    before, after = rows(kept[3]), rows(kept[4])
    sizes, taken, each = defaultdict(int), defaultdict(int), Counter()
    text = {r["doc_id"]: r["text"] for r in before}
    for r in before:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in after:
        n = len(WORD.findall(r["text"]))
        taken[r["source"]] += n
        each[r["doc_id"]] += n
        assert text[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    want = brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_packing_stage(kept):
    """Every piece holds its document's ids by the library's plain call; sequences are full but the last."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    mixed, packed = rows(kept[4]), rows(kept[5])
    ids = defaultdict(set)
    for r in mixed:
        ids[r["doc_id"]].add((*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1))
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
        crc = lambda x: zlib.crc32(b"".join(t.to_bytes(4, "little") for t in x[r["start"] : r["start"] + r["length"]]))  # noqa: E731, B023
        assert any(len(x) == r["doc_tokens"] and crc(x) == r["ids_crc32"] for x in ids[r["doc_id"]])
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)
    assert all(n == 2048 for s, n in used.items() if s != max(used)) and sorted(used) == list(range(len(used)))


def test_odd_rows(spark, odd_docs, no_docs):
    """Each stage alone, then one after another."""
    total = odd_docs.count()
    alone = {name: stage(spark, odd_docs, "") for name, stage in P.STAGES}
    assert {r["doc_id"] for r in rows(alone["language_id"])} <= {3, 4, 5, 6, 7, 8}
    assert sorted(r["doc_id"] for r in rows(alone["near_dedup"])) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert Counter(r["text"] for r in rows(alone["secret_scan"])) == Counter(r["text"] or "" for r in rows(odd_docs))
    assert all(r["text"] in {x["text"] for x in rows(odd_docs)} or r["n_chars"] == len(r["text"]) for r in rows(alone["mixing"]))
    assert sum(r["start"] == 0 for r in rows(alone["packing"])) == total
    for start in (odd_docs.select("doc_id", "text", "lang", "source", "n_chars"), no_docs):
        docs = start
        for name, stage in P.STAGES:
            docs = P.written(stage(spark, docs, ""), f"odd-{name}")
            if start is no_docs:
                assert docs.count() == 0
