import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import langid as L


def test_held_out_accuracy(spark, sf):
    rows = L.op7_bitmask(spark, sf).collect()
    lang = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in rows)


def folded(text):
    """Lower case, every run of code points that are no letters as one blank, blanks at the ends."""
    out = [" "]
    for c in text.lower():
        c = c if unicodedata.category(c)[0] == "L" else " "
        if c != " " or out[-1] != " ":
            out.append(c)
    return "".join(out if out[-1] == " " else [*out, " "])


def brute_fit(rows, sample, profile):
    """Sets of n-grams of each language, by plain strings; hashes only break ties and choose the sample."""
    texts = {}
    for lang, text in rows:
        if lang is not None and text is not None:
            h = xxhash.xxh64_intdigest(text.encode(), seed=42)
            texts.setdefault(lang, {})[h - (h >> 63 << 64)] = text
    out = {}
    for lang, by in texts.items():
        out[lang] = set()
        for n in L.LENGTHS:
            df = Counter(g for h in sorted(by)[:sample] if len(f := folded(by[h])) > 1 for g in {f[i : i + n] for i in range(len(f) - n + 1)})
            key = lambda g: (-df[g], int(L.grams(np.array([ord(c) for c in g], dtype="uint32"), len(g)).view("int64")[0]))  # noqa: E731, B023
            out[lang] |= set(sorted(df, key=key)[:profile])
    return out


def brute_shares(text, sets):
    f = folded(text)
    g = [f[i : i + n] for n in L.LENGTHS for i in range(len(f) - n + 1)]
    return {lang: sum(x in s for x in g) / len(g) for lang, s in sets.items()}


def test_scores_against_plain_sets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    sets = brute_fit([(lang, t) for _, t, lang in rows], 12, 150)
    model = L.fit(docs, sample=12, profile=150)
    assert model.languages == sorted(sets)
    got = {r["doc_id"]: r for r in L.identify(docs, model).collect()}
    for i, text, _ in rows:
        if len(folded(text)) > 1:
            want = brute_shares(text, sets)
            best = sorted(want.values())
            assert got[i]["share"] == pytest.approx(max(want.values()), abs=0.02)
            if best[-1] - best[-2] > 0.04:
                assert want[got[i]["lang_pred"]] == best[-1]
        else:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)


def test_windows_give_the_same_counts(monkeypatch):
    text = "Der schnelle Fuchs, 12 springt! " * 50
    model = L.Filter({"de": np.unique(L.grams(L.folded(text), 3))})
    whole = model.shares(L.folded(text))
    monkeypatch.setattr(L, "WINDOW", 7)
    assert np.allclose(model.shares(L.folded(text))[0], whole[0]) and model.shares(L.folded(text))[1] == whole[1]


def test_letters_are_category_l():
    assert len(L.folded("² ½ Ⅷ ٣ “—” 。、 _ 7")) == 0 and len(L.folded("ª")) and len(L.folded("語"))
    assert "".join(map(chr, L.folded("A1b--Ç"))) == " a b ç "


def test_many_languages(spark):
    """More languages than one mask holds; a group of copies of one language; long texts."""
    words = {f"l{i:03}": " ".join(chr(0x4E00 + 40 * i + j) * 3 + chr(0x4E00 + 40 * i + j + 1) for j in range(30)) for i in range(70)}
    rows = [(i, t, lang) for i, (lang, t) in enumerate(words.items())] + [(1000 + i, words["l003"], "l003") for i in range(50)]
    df = spark.createDataFrame([*rows, (5000, words["l069"] * 3000, None)], "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(df, L.fit(df, sample=1)).collect()}
    assert got == {**{i: lang for i, _, lang in rows}, 5000: "l069"}


def test_filter_holds_all_languages_and_corrects():
    a, b = (np.concatenate([L.grams(L.folded(t), 3)]) for t in ("the cat sat on the mat", "die katze sitzt auf der matte"))
    f = L.Filter({"x": a, "y": np.concatenate([a, b])})
    assert f.shares(L.folded("the cat sat on the mat"))[0].shape == (2,)
    mask = f.slots[0][L._slots(a, 0)]
    assert np.all(mask & np.uint64(3) == 3)
    assert np.all(f.false < 1e-3)


def test_odd_rows(spark, odd_docs, no_docs):
    model = L.fit(odd_docs)
    got = L.identify(odd_docs, model).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[0] == by[1] == by[2] == "und" and by[4] == "en"
    assert L.identify(no_docs, L.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd_docs, L.fit(no_docs)).collect()} == {"und"}
