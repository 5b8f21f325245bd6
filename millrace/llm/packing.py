"""Concatenate and cut: documents become one stream of token ids, cut every ``length`` ids.

First pass: every input partition encodes its documents and writes, in the shared folder, the
ids and each document's place in the partition's own stream. Second pass: prefix sums over the
partitions' token totals (one row a partition) give global offsets, and the written ids are cut
at multiples of ``length``. A sequence that spans partitions is the union of their pieces, which
carry their place in it; only such boundary sequences move when sequences are assembled.
The stream has no gaps, so only the last sequence of all is padded.

Edge cases: null text is the empty text, which still has the end id; an empty table gives no
pieces; repeated rows are packed as often as they occur; a text of any length is cut freely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lean, table, text_of, written
from .encoder import Encoder, binaries, crc32_u32, slices, vocabulary_path

LENGTH = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """First pass, written: part, at (ids before it in the part), key, n_tokens, ids (uint16 binary)."""
    path = vocabulary or vocabulary_path()

    def encode(batches):
        encoder, part, at = Encoder.of(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1):
                ids, n = encoder.encode(b.column(1))
                ends = at + np.cumsum(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype="int32")), pa.array(ends - n), b.column(0), pa.array(n), binaries(ids, n)], ["part", "at", "key", "n_tokens", "ids"])
                at = int(ends[-1])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(docs, text).alias("text"))
    return written(rows.mapInArrow(lean(encode), "part int, at long, key long, n_tokens long, ids binary"), "packing")


def offsets(first: DataFrame) -> DataFrame:
    """part, base: ids in all parts before it. One row for each partition of the first pass."""
    totals = first.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))


def pieces(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; with ids (array<int>) on request."""
    first = encoded(docs, key, text, vocabulary)
    placed = first.join(F.broadcast(offsets(first)), "part").select("key", (F.col("base") + F.col("at")).alias("at"), "n_tokens", "ids")

    def cut(batches):
        for batch in batches:
            for b in slices(batch, 3):
                out = [[] for _ in range(8)]
                for doc, at, n, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                    values = np.frombuffer(ids.as_buffer(), dtype="<u2")
                    start = 0
                    while start < n:
                        offset = (at + start) % length
                        stop = min(n, start + length - offset)
                        part = values[start:stop]
                        for column, value in zip(out, (doc, start, stop - start, crc32_u32(part), n, (at + start) // length, offset, part.astype("int32") if with_ids else None), strict=True):
                            column.append(value)
                        start = stop
                arrays = [pa.array(c, pa.int64()) for c in out[:7]]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
                if with_ids:
                    arrays.append(pa.array(out[7], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return placed.mapInArrow(lean(cut), PIECES + (", ids array<int>" if with_ids else ""))


def sequences(docs: DataFrame, length: int = LENGTH, pad_id: int = 0, **options) -> DataFrame:
    """sequence_id, ids: the packed sequences, each of ``length`` ids; the last is padded."""
    parts = pieces(docs, length, with_ids=True, **options)
    joined = parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    return joined.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(ids))).alias("ids"))


def op9_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
