"""I-Match fingerprints.

Terms are lower-cased letter/digit runs. Terms whose inverse document frequency over the
whole corpus lies in a band form the lexicon; a document keeps its distinct lexicon terms,
sorted, and each of several randomised sub-lexicons hashes the kept terms it holds. The
fingerprint is those hashes; the likeness of two fingerprints is the share of equal ones.

The lexicon is kept as a bit set of ``2 ** lexicon_bits`` positions addressed by the term's
64-bit hash, so that what tasks get of it has a fixed size (128 KiB) at any corpus size; terms
that share a position with a lexicon term count as lexicon terms (6 % of the others where
65,000 positions are set). Sub-lexicons thin out in
steps, so that likeness falls gradually as the number of differing terms grows.

Edge cases: a null text is the empty text; a text without lexicon terms in a sub-lexicon
hashes all its lexicon terms, and without any of those its whole text, so different texts
do not agree by having nothing. Equal texts always have equal fingerprints. Rows that repeat a
key follow one another by text; null keys come first; the last row's next is the first with a
key (itself, where it is alone); long texts are read whole; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_partitions, own_names, table, text_of, written

#: Shares of the lexicon the sub-lexicons keep, as negative powers of two.
SUBSETS = (1, 2, 3, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9, 9)
IDF_BAND = (math.log(50), math.log(2000))
LEXICON_BITS = 20
SEED = 20250


def _terms(text: Column) -> Column:
    """Hashes of the text's distinct terms."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", idf_band=IDF_BAND, bits: int = LEXICON_BITS) -> DataFrame:
    """One row: ``lexicon`` array<long>, the bit set of terms whose IDF over all of ``docs`` is in the band."""
    n = docs.count()
    lo, hi = (n / math.exp(x) for x in (idf_band[1], idf_band[0]))
    counts = docs.select(F.explode(_terms(text_of(docs, text))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
    # a corpus smaller than the band's width keeps its rarest terms, as their IDF lies below the band's top
    kept = counts.where((F.col("df") >= lo) & (F.col("df") <= max(hi, 1.0)))
    words = 1 << (bits - 6)
    pos = F.shiftrightunsigned("h", 64 - bits)
    packed = kept.groupBy(F.shiftrightunsigned(pos, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int))")).alias("b"))
    dense = docs.sparkSession.range(words).withColumnRenamed("id", "w").join(packed, "w", "left").select("w", F.coalesce("b", F.lit(0)).alias("b"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("lexicon"))


def _kept_terms(text: Column, lex: Column, bits: int) -> Column:
    """Sorted hashes of the text's distinct lexicon terms."""

    def inside(h: Column) -> Column:
        p = F.shiftrightunsigned(h, 64 - bits)
        return F.getbit(F.get(lex, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

    return F.sort_array(F.filter(_terms(text), inside))


def fingerprint_columns(df: DataFrame, text: Column, lex: DataFrame, name: str, bits: int = LEXICON_BITS, subsets=SUBSETS) -> DataFrame:
    """Add ``name`` array<long>: the fingerprint of ``text``; ``lex`` is lexicon()'s row, a scalar subquery (of fixed size)."""
    plain = [F.col(f"`{c}`") for c in df.columns]
    t, held, terms, all_of = own_names(df, "t", "held", "terms", "all_of")
    kept = df.withColumns({t: text, held: lex.select("lexicon").scalar()})
    kept = kept.select(*plain, t, _kept_terms(F.col(t), F.col(held), bits).alias(terms))
    every = F.when(F.size(terms) > 0, F.xxhash64(terms)).otherwise(F.xxhash64(F.col(t), F.lit(1)))
    kept = kept.select(*plain, terms, every.alias(all_of))

    # a sub-lexicon holds the terms whose hash has zeros at its own random bits, below those that address the lexicon
    draw = random.Random(SEED)
    masks = [sum(1 << i for i in draw.sample(range(64 - bits), p)) for p in subsets]

    def sub(k: int) -> Column:
        part = F.filter(terms, lambda h: h.bitwiseAND(F.lit(masks[k])) == 0)
        return F.when(F.size(part) > 0, F.xxhash64(part, F.lit(k))).otherwise(F.col(all_of))

    return kept.select(*plain, F.array(*[sub(k) for k in range(len(subsets))], F.col(all_of)).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes of two fingerprints."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("int"))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(a).cast("double")


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(df: DataFrame, key: str, carry: list[str], block_rows: int = 4096) -> DataFrame:
    """Add ``next_<c>`` for each carried column: the value in the row that follows by ``key``; the first row follows the last.

    Blocks of neighbouring keys are shuffled, and each block also gets the first row of the
    one after it, so no task sees more than a block. Bounds are sampled quantiles; rows with
    one key stay in one block and are ordered by the carried columns.
    """
    n, lowest = df.agg(F.count(key), F.min(key)).first()
    blocks = max(1, min(1 << 16, max(2 * n_partitions(df.sparkSession), n // block_rows)))
    bounds: list[int] = []
    if blocks > 1 and n:
        q = df.agg(F.percentile_approx(key, [i / blocks for i in range(1, blocks)], 100_000)).first()[0]
        bounds = sorted(set(q) - {lowest})
    depth = len(bounds).bit_length()
    if bounds:
        # one literal, folded before the plan runs
        ordered = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

        def step(at: Column, k: Column) -> Column:
            # binary search, one bit of the answer at a time
            probe = at + F.call_function("shiftleft", F.lit(1), k)
            return F.when((probe <= len(bounds)) & (F.get(ordered, probe - 1) <= F.col(key)), probe).otherwise(at)

        block = F.aggregate(F.sequence(F.lit(depth - 1), F.lit(0), F.lit(-1)), F.lit(0), step)
        first = F.get(ordered, F.col("_b") - 1) == F.col(key)
    else:
        block, first = F.lit(0), F.lit(False)
    last = len(bounds)
    placed = df.withColumn("_b", block)
    also = F.when(F.col(key) == lowest, F.array(F.struct(F.lit(last).alias("b"), F.lit(2).alias("o")))).when(first, F.array(F.struct((F.col("_b") - 1).alias("b"), F.lit(1).alias("o")))).otherwise(F.array().cast("array<struct<b:int,o:int>>"))
    spots = F.concat(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("o"))), also)
    spread = placed.withColumn("_s", F.explode(spots)).drop("_b")
    w = W.partitionBy(F.col("_s.b")).orderBy(F.col("_s.o"), key, *[c for c in carry])
    out = spread.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carry], F.col("_s.o").alias("_o"))
    return out.where(F.col("_o") == 0).drop("_o", "_s")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint every document and its edited text (the last half replaced by the start of the next document).

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    base = docs.select(F.col(key), text_of(docs, text).alias("text"))
    lex = written(lexicon(base), "lexicon")
    first = fingerprint_columns(base, F.col("text"), lex, "fp")
    pairs = with_next(first, key, ["text", "fp"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    both = pairs.select(key, n.cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    out = fingerprint_columns(both, F.col("edited"), lex, "efp")
    return out.select(
        key, "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op1_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
