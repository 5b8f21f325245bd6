import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import packing as P
from millrace.llm import token_files as K
from millrace.llm.encoder import Encoder, vocabulary_path

TRICKY = ["it's <|endoftext|> x<|endoftext|>y 'll ١٢٣ Ünḯ don't!!'s a b", "İİx 5% aſ ΣΑΣ.", "", " ", "a\x1cb c\x85d\xa0e ×÷x Ǆa ﬁ é́x ́", "x" * 3000, "😀 a<b <|start", "ﬀ 　z", "A'S 'RE'VE"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary_path())


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def docs_of(df):
    return sorted((r[0], r[1] or "") for r in df.select("doc_id", "text").collect())


def test_encoder_equals_the_library(spark, sf, encoder, monkeypatch):
    texts = TRICKY + [t for _, t in docs_of(spark.read.parquet(f"{sf}/documents.parquet"))]
    for room in (Encoder.CACHE, 10):
        monkeypatch.setattr(Encoder, "CACHE", room)
        ids, n = Encoder(vocabulary_path()).encode(pa.array(texts))
        ends = [0, *np.cumsum(n).tolist()]
        assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)] == encoder.exact(texts)


def test_known_pieces_are_not_encoded_again(encoder, monkeypatch):
    """A cache holds each piece once: chunks in capitals or with punctuation, and a piece alone, take no call of the library."""
    own = Encoder(vocabulary_path())
    own.encode(pa.array(["zorvan quillet don't", "x,"]))
    before, asked = len(own.known), []
    for name in ("_plain", "_encode_pieces"):
        monkeypatch.setattr(own, name, lambda x, f=getattr(own, name): asked.extend(x) or f(x))
    texts = ["Zorvan, QUILLET quillet,zorvan 't zorvan't x", "don ,, X,,", "", "zorvan 日本 " + "y" * 70]
    ids, n = own.encode(pa.array(texts))
    ends = [0, *np.cumsum(n).tolist()]
    assert [ids[i:j].tolist() for i, j in zip(ends, ends[1:], strict=False)] == encoder.exact(texts)
    assert sorted(asked) == sorted([",,", "日本", "y" * 70])
    assert len(own.known) == before + 2


def test_memory_of_an_encoder(encoder):
    """What a worker keeps is some 30 bytes a piece, not objects; what it takes meanwhile is bounded by portions, not by a slice's chunks."""
    own = Encoder(vocabulary_path())
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}zq,{i % 7}-{i}X" for i in range(60_000))])
    own.encode(pa.array(["warm up"]))
    tracemalloc.start()
    try:
        arrow = pa.total_allocated_bytes()
        ids, n = own.encode(texts)
        pieces, held = len(own.known), ids.nbytes + n.nbytes
        kept, most = (x - held for x in tracemalloc.get_traced_memory())
        kept += pa.total_allocated_bytes() - arrow
    finally:
        tracemalloc.stop()
    assert pieces > 60_000 and kept < 50 * pieces
    assert most < 600 * 60_000
    assert ids.tolist() == encoder.exact(texts.to_pylist())[0]


def test_token_files(spark, sf, encoder, odd_docs, no_docs, tmp_path):
    docs = docs_of(spark.read.parquet(f"{sf}/documents.parquet"))
    want, at = [], 0
    for (i, _), ids in zip(docs, encoder.exact([t for _, t in docs]), strict=True):
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert [tuple(r) for r in K.op3_token_files(spark, sf).orderBy("doc_id").collect()] == want
    for k, df in enumerate((odd_docs, no_docs)):
        K.write_tokens(df, f"file://{tmp_path}/{k}")
        rows = K.read_tokens(spark, f"file://{tmp_path}/{k}").orderBy("start").collect()
        assert len(rows) == df.count()
        assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in rows])])[:-1].astype(int).tolist()


def test_layout_of_files(spark, sf, tmp_path):
    import pyarrow.parquet as pq

    K.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), f"file://{tmp_path}/t")
    part = next(p for p in sorted((tmp_path / "t").glob("*.parquet")))
    column = {c.path_in_schema: c for g in range(pq.ParquetFile(part).num_row_groups) for c in (pq.ParquetFile(part).metadata.row_group(g).column(i) for i in range(5))}
    ids = column["ids.list.element"]
    assert "DELTA_BINARY_PACKED" in ids.encodings and ids.has_column_index and ids.has_offset_index
    plan = K.read_tokens(spark, f"file://{tmp_path}/t").select("key", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan


def check_pieces(rows, docs, encoder, length=2048):
    ids = {}
    for (i, _), x in zip(docs, encoder.exact([t for _, t in docs]), strict=True):
        ids.setdefault(i, x)
    fill, covered = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and crc(part) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered[r["doc_id"]] = covered.get(r["doc_id"], 0) + r["length"]
    for s, spans in fill.items():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at == length or s == max(fill)
    return covered


def test_packing(spark, sf, encoder, odd_docs, no_docs):
    docs = docs_of(spark.read.parquet(f"{sf}/documents.parquet"))
    covered = check_pieces(P.op9_concat_cut(spark, sf).collect(), docs, encoder)
    assert all(covered[i] == len(x) for (i, _), x in zip(docs, encoder.exact([t for _, t in docs]), strict=True))
    check_pieces(P.pieces(odd_docs, 16).collect(), docs_of(odd_docs), encoder, 16)
    assert P.pieces(no_docs).count() == 0


def test_sequences_join_boundary_pieces(spark, sf, encoder):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    seqs = P.sequences(docs, 512, pad_id=7).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 512 for r in seqs) and [r["sequence_id"] for r in seqs] == list(range(len(seqs)))
    total = sum(map(len, encoder.exact([t for _, t in docs_of(docs)])))
    assert len(seqs) == -(-total // 512)
    assert docs.select(F.count("*")).first()[0] > 0
