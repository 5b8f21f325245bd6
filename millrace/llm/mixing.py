"""Mixing sources to target weights by a time-varying curriculum.

Each source's target is its share by weight of the whole budget, capped at ``repeats`` times its
size; what a cap leaves over is shared again by weight (water-filling, solved in closed form over
the sources sorted by cap per weight). Its rate of demand over training time t in [0, 1] is
``target * (1 + slope * (2 t - 1))``, so it has used ``target * (t + slope * (t * t - t))`` by t.
A source's documents are put in random order; inverting the cumulative demand at the number of
words before a document's pass gives that pass its training position. A pass that begins after
the target is not taken, the one that crosses it is cut there, so a source takes its target,
rounded. ``schedule`` range-sorts the taken passes by position.

Running sums are prefix sums over random blocks of a source's documents (a hot source has as
many blocks as its rows need), so no task holds a source. Everything is a function of rows and
seed: reruns agree, equal rows differ only in order.

Edge cases: null text has size 0 and takes nothing; a null source is a source, ordered last;
an empty table gives an empty result; a source without words has target 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, n_partitions, table, written

REPEATS = 3
WEIGHTS = (1, 2, 3)
#: Slopes of the demand's rate, by the source's place: falling, level and rising over training.
SLOPES = (-0.5, 0.0, 0.5)
SEED = 11
#: Rows and words of a block on average, at most; the largest source has at least twice as many blocks as a shuffle has partitions.
BLOCK_ROWS, BLOCK_WORDS = 20_000, 4_000_000
#: Sums of blocks are broadcast up to so many rows (a few MB), else joined by a shuffle.
BROADCAST_ROWS = 50_000


def _cycle(values, place: Column) -> Column:
    return F.element_at(F.lit(list(values)), F.pmod(place - 1, F.lit(len(values))).cast("int") + 1)


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, slopes=SLOPES) -> DataFrame:
    """source, source_size, weight, slope, target of each source. ``sizes``: source, source_size (one row a source)."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.withColumn("place", F.row_number().over(by_name))
    s = placed.select("source", "source_size", _cycle([float(w) for w in weights], F.col("place")).alias("weight"), _cycle([float(x) for x in slopes], F.col("place")).alias("slope"))
    s = s.withColumn("cap", F.col("source_size") * float(repeats)).withColumn("ratio", F.col("cap") / F.col("weight"))
    # sources below the water level are capped; the level is that of the first source it does not cap, the highest that fits
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("try", (F.sum("source_size").over(everything) - spent) / rest)
    s = s.withColumn("level", F.max(F.when(F.col("try") <= F.col("ratio"), F.col("try"))).over(everything))
    return s.select("source", "source_size", "weight", "slope", F.least(F.col("level") * F.col("weight"), "cap").alias("target"))


def position(used: Column, slope: Column) -> Column:
    """The time t by which the share ``used`` of a target is used: inverse of t + slope * (t * t - t)."""
    b = 1 - slope
    # the form without cancellation, right for any slope in [-1, 1]
    root = F.sqrt(F.greatest(b * b + 4 * slope * used, F.lit(0.0)))
    return F.when(used <= 0, 0.0).otherwise(2 * used / (b + root))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, repeats: int = REPEATS, slopes=SLOPES, seed: int = SEED, carry: str | None = None) -> DataFrame:
    """key, source, size, source_size, target, taken, passes (array of pass, words, position) and the carried column, for every document."""
    more = [carry] if carry else []
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    # a function of the row alone, whatever the partitions; rows that tie are equal in key and text
    order = F.xxhash64(F.lit(seed), F.col(key), F.col(text))
    columns = [F.col(key), F.col(source).alias("source"), size.alias("size"), order.alias("_k")]
    narrow = written(docs.select(*columns), "mixing")
    shared = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    plan = targets(shared.select("source", "source_size"), weights, repeats, slopes)
    # blocks of the random order, as many as the largest source needs
    largest, words = (x or 0 for x in shared.agg(F.max("_n"), F.max("source_size")).first())
    tasks = 2 * n_partitions(docs.sparkSession)
    bits = max(2, math.ceil(math.log2(max(1, largest / BLOCK_ROWS, words / BLOCK_WORDS, min(tasks, largest)))))
    block = F.shiftrightunsigned("_k", 64 - bits)
    # what is carried is shuffled once, with its row, and not written
    rows = (docs.select(*columns, *more) if carry else narrow).withColumn("_b", block)
    blocks = narrow.withColumn("_b", block).groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    blocks = blocks.withColumn("_before", F.sum("_sum").over(W.partitionBy("source").orderBy("_b")) - F.col("_sum"))
    p = plan.withColumnRenamed("source", "_s")
    blocks = blocks.join(p, blocks["source"].eqNullSafe(p["_s"])).select(F.col("source").alias("_s"), F.col("_b").alias("_bb"), "_before", "source_size", "slope", "target")
    blocks = written(blocks, "blocks")
    if blocks.count() <= BROADCAST_ROWS:
        blocks = F.broadcast(blocks)
    within = W.partitionBy("source", "_b").orderBy(F.shiftleft("_k", bits), key, "size")
    at = rows.withColumn("_at", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    joined = at.join(blocks, at["source"].eqNullSafe(blocks["_s"]) & (at["_b"] == blocks["_bb"]))
    goal = F.round("target").cast("long")
    offset = lambda i: (i - 1) * F.col("source_size") + F.col("_before") + F.col("_at")
    used = lambda i: F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - offset(i)))
    passes = F.filter(
        F.transform(F.sequence(F.lit(1), F.lit(repeats)), lambda i: F.struct(i.alias("pass"), used(i).alias("words"), position(offset(i) / F.greatest(F.col("target"), F.lit(1.0)), F.col("slope")).alias("position"))),
        lambda x: x["words"] > 0,
    )
    out = joined.withColumn("passes", passes)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return out.select(key, "source", "size", "source_size", "target", taken.alias("taken"), "passes", *more)


def schedule(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pass, words, position of every taken pass, range-sorted by position: the order of training."""
    rows = assigned.select(key, F.explode("passes").alias("p")).select(key, "p.pass", "p.words", "p.position")
    return rows.orderBy("position", key, "pass")


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **options) -> DataFrame:
    """The rows of the mix, one for each taken pass, range-sorted by training position.

    ``docs`` carries its rows through the assignment, so each pass has its own row's columns.
    A cut pass holds its text's first words, and their number of characters in ``n_chars``.
    """
    carried = docs.select(F.col(key), F.col("source"), F.col(text), F.struct(*docs.columns).alias("_row"))
    rows = assign(carried, key, text, carry="_row", **options)
    taken = rows.select(key, "size", "_row", F.explode("passes").alias("_p"))
    whole = F.col("_p.words") == F.col("size")
    # a cut text ends where the first word that is not taken begins; a blank start splits off as an empty part
    white = r"[\x20\x09-\x0D]"
    t = F.col(f"_row.`{text}`")
    limit = F.col("_p.words").cast("int") + 1 + F.coalesce(t.rlike(f"^{white}").cast("int"), F.lit(0))
    first_words = F.substring(t, F.lit(1), F.length(t) - F.length(F.element_at(F.split(t, f"{white}+", limit), -1)))
    cut = F.when(whole, t).otherwise(first_words)
    sorted_rows = taken.select("*", cut.alias("_cut")).repartitionByRange(n_partitions(docs.sparkSession), F.col("_p.position"), F.col(key), F.col("_p.pass"))
    sorted_rows = sorted_rows.sortWithinPartitions(F.col("_p.position"), key, F.col("_p.pass"))
    columns = {text: F.col("_cut"), n_chars: F.when(whole, F.col(f"_row.`{n_chars}`")).otherwise(F.length("_cut").cast("long"))}
    return sorted_rows.select(*[columns.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the positions of all its passes, range-sorted by the first; documents that are not taken come last."""
    a = assign(table(spark, sf_dir, "documents"))
    positions = F.transform("passes", lambda p: p["position"])
    rows = a.select("doc_id", "size", "source_size", "target", "taken", F.get(positions, F.lit(0)).alias("position"), positions.alias("positions"))
    return rows.orderBy(F.col("position").asc_nulls_last(), "doc_id")
