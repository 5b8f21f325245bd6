"""Token ids as Parquet list columns that can be read selectively.

Files hold one row a document: key, part, at, n_tokens and ids (list<int32>). Ids are written
with delta encoding (Parquet v2 pages, no dictionary: the range of ids is wide), the other
columns with a dictionary where it pays. Row groups are bounded in bytes and pages in rows;
the writer adds column and offset indexes, so a reader of a key range skips pages, and a
reader of counts never touches the ids.

Rows are range-partitioned and sorted by key, then encoded in place, so files ascend by key
and each row knows its place in its file's stream. Reading back, prefix sums over the files'
totals give the number of ids before each document.

Edge cases: null text is the empty text and has only the end id; rows with an equal key are
ordered by text; null keys come first; an empty table writes files without rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import lean, n_partitions, new_path, table, text_of
from .encoder import Encoder, slices, vocabulary_path

SCHEMA = "part int, key long, at long, n_tokens long, ids array<int>"
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#ids.list.element": "false",
}


def write_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, layout: dict[str, str] | None = None) -> None:
    """Encode every text and write the files in ascending key order."""
    voc = vocabulary or vocabulary_path()

    def encode(batches):
        encoder, part, at = Encoder.of(voc), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, 1):
                ids, n = encoder.encode(b.column(1))
                ends = at + np.cumsum(n)
                bounds = np.concatenate([[0], np.cumsum(n)]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype("int32")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, dtype="int32")), b.column(0), pa.array(ends - n), pa.array(n), lists], ["part", "key", "at", "n_tokens", "ids"])
                at = int(ends[-1])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(docs, text).alias("text"))
    n = n_partitions(docs.sparkSession)
    ordered = rows.repartitionByRange(n, "key").sortWithinPartitions("key", "text")
    ordered.mapInArrow(lean(encode), SCHEMA).write.options(**(layout or LAYOUT)).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids; columns that are not asked for are not read."""
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("total"))
    base = totals.select("part", (F.sum("total").over(W.orderBy("part")) - F.col("total")).alias("base"))
    return files.join(F.broadcast(base), "part").select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens() gives."""

    def crc(batches):
        for b in batches:
            lists = b.column(3)
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(lean(crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path)
    return digests(read_tokens(spark, path))
