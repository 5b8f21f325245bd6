"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

1. Rows get a cell (a hash of the key and of the row's place, so that repeated keys spread)
   and are put in random order within it: the local permutation.
2. The numbers of rows that each cell sends to each shard are drawn with the exact law they
   have under a uniform permutation: cells are halved again and again, and at each halving
   the shard counts split by multivariate hypergeometric draws. Draws invert the distribution
   outwards from its mode, with a uniform number hashed from the seed and the node.
3. A cell's rows go to shards by the running sums of its counts: the exchange.
4. Within a shard, rows are ordered by a second random number: the second permutation. Places
   (slots) are prefix sums over blocks of that number plus the place in the block.

Shard sizes differ by one row at most. All windows are over cells or blocks of bounded size.
Edge cases: null text has size 16 and the crc32 of the empty string; null keys are keys; long texts
move whole; an empty table gives an empty result; equal rows are separate rows; with fewer rows
than shards some shards are empty; other columns may have any names but shard and slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, own_names, table, text_of, written

SHARDS, SEED = 40, 7
#: Rows of a cell or a slot block, on average.
CELL_ROWS = 20_000
#: Below this, log-factorials are summed exactly; above, by Stirling's series (error below 1e-10).
SMALL = 32


def let(body, **fields: Column) -> Column:
    """``body`` of a struct of the fields, each of which is computed once."""
    return F.get(F.transform(F.array(F.struct(*[e.alias(n) for n, e in fields.items()])), body), F.lit(0))


def _log_factorial(x: Column) -> Column:
    exact = F.lit([math.lgamma(i + 1) for i in range(SMALL)])
    z = x + F.lit(1.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return F.when(x < SMALL, F.get(exact, x.cast("int"))).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` items, out of ``total`` of which ``good`` are marked, are marked: one draw for each ``uniform``.

    Starts at the mode and adds terms on both sides, nearest first, until their sum passes ``uniform``.
    """
    lf = _log_factorial

    def search(c: Column) -> Column:
        t, k, n = c["t"], c["k"], c["n"]

        def step(s: Column, _: Column) -> Column:
            up = F.when(s["u"] < c["hi"], s["pu"] * (k - s["u"]) * (n - s["u"]) / ((s["u"] + 1.0) * (t - k - n + s["u"] + 1.0))).otherwise(0.0)
            down = F.when(s["d"] > c["lo"], s["pd"] * s["d"] * (t - k - n + s["d"]) / ((k - s["d"] + 1.0) * (n - s["d"] + 1.0))).otherwise(0.0)

            def grown(p: Column) -> Column:
                rest = s["left"] - p["up"]
                x = F.when(rest < 0, s["u"] + 1).when(rest - p["down"] < 0, s["d"] - 1).otherwise(s["x"])
                return F.struct((rest - p["down"]).alias("left"), F.least(c["hi"], s["u"] + 1).alias("u"), F.greatest(c["lo"], s["d"] - 1).alias("d"), p["up"].alias("pu"), p["down"].alias("pd"), x.alias("x"))

            return F.when(s["left"] < 0, s).otherwise(let(grown, up=up, down=down))

        m = c["m"]
        start = F.struct((c["r"] - c["p"]).alias("left"), m.alias("u"), m.alias("d"), c["p"].alias("pu"), c["p"].alias("pd"), m.alias("x"))
        width = F.ceil(10 * F.sqrt(n * (k / t) * (1 - k / t) + 1) + 10).cast("int")
        return F.when((t <= 0) | (c["lo"] == c["hi"]), c["lo"]).otherwise(F.aggregate(F.sequence(F.lit(1), width), start, step, lambda s: s["x"]))

    def at_mode(b: Column) -> Column:
        t, k, n, m = b["t"], b["k"], b["n"], b["m"]
        p = F.exp(lf(k) - lf(m) - lf(k - m) + lf(t - k) - lf(n - m) - lf(t - k - n + m) - lf(t) + lf(n) + lf(t - n))
        return let(search, **{x: b[x] for x in ("t", "k", "n", "r", "lo", "hi", "m")}, p=p)

    def bounded(a: Column) -> Column:
        t, k, n = a["t"], a["k"], a["n"]
        lo, hi = F.greatest(F.lit(0).cast("long"), n + k - t), F.least(k, n)
        m = F.least(hi, F.greatest(lo, F.floor((n + 1.0) * (k + 1.0) / (t + 2.0)).cast("long")))
        return let(at_mode, t=t, k=k, n=n, r=a["r"], lo=lo, hi=hi, m=m)

    return let(bounded, t=total.cast("long"), k=good.cast("long"), n=drawn.cast("long"), r=uniform)


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) hashed from the parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / float(1 << 53)


def _split(counts: Column, drawn: Column, *node: Column) -> Column:
    """Of each shard's count, how many rows the first of two halves takes, which takes ``drawn`` in all."""

    def step(s: Column, i: Column) -> Column:
        k = F.get(counts, i)
        return let(lambda x: F.struct((s["t"] - k).alias("t"), (s["n"] - x["x"]).alias("n"), F.concat(s["out"], F.array(x["x"])).alias("out")), x=hypergeometric(s["t"], k, s["n"], uniform(*node, i)))

    start = F.struct(F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).alias("t"), drawn.cast("long").alias("n"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(counts) - 1), start, step, lambda s: s["out"])


def communication_matrix(cells: DataFrame, levels: int, shards: int, seed: int) -> DataFrame:
    """cell, counts array<long>: rows each of 2 ** levels cells sends to each shard. ``cells``: cell, n."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor((F.col("n") + shards - 1 - s) / shards).cast("long"))
    nodes = total.select(F.lit(0).cast("long").alias("cell"), sizes.alias("counts"))
    for level in range(levels - 1, -1, -1):
        left = cells.where(F.shiftright("cell", level).bitwiseAND(F.lit(1).cast("long")) == 0).groupBy(F.shiftright("cell", level + 1).alias("cell")).agg(F.sum("n").alias("n"))
        split = nodes.join(left, "cell", "left").withColumn("l", _split(F.col("counts"), F.coalesce("n", F.lit(0)), F.lit(seed), F.lit(level), F.col("cell")))
        halves = F.array(F.struct((F.col("cell") * 2).alias("cell"), F.col("l").alias("counts")), F.struct((F.col("cell") * 2 + 1).alias("cell"), F.zip_with("counts", "l", lambda a, b: a - b).alias("counts")))
        nodes = split.select(F.explode(halves).alias("h")).select("h.cell", "h.counts")
        if level % 6 == 0 and level:
            nodes = written(nodes, "matrix")  # keeps the plan short
    return written(nodes, "matrix")


def assign(df: DataFrame, key: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add shard and slot to every row of ``df``, which is written once so that rows keep their identity.

    Places are found over row numbers alone; the rows themselves, whatever they hold, move once, in
    the join that gives them their shard. ``shard`` and ``slot`` must not be columns of ``df``.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten: rename them first")
    rid, cell = own_names(df, "rid", "cell")
    whole = written(df.withColumn(rid, F.monotonically_increasing_id()), "rows")
    n = whole.count()
    levels = max(4, math.ceil(math.log2(max(1, n / CELL_ROWS))))
    named = whole.select(F.col(rid).alias("rid"), F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.col(rid)), 64 - levels).alias("cell"))
    rows = written(named, "cells")
    matrix = communication_matrix(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), levels, shards, seed)
    local = W.partitionBy("cell").orderBy(F.xxhash64(F.lit(seed + 1), "rid"), "rid")
    placed = rows.withColumn("at", F.row_number().over(local)).join(matrix, "cell")
    upto = F.aggregate("counts", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("shard")), lambda s, c: F.struct((s["sum"] + c).alias("sum"), (s["shard"] + F.when(s["sum"] + c < F.col("at"), 1).otherwise(0)).alias("shard")), lambda s: s["shard"])
    bits = max(2, math.ceil(math.log2(max(1, n / shards / CELL_ROWS))) + 1)
    sent = placed.select("rid", upto.alias("shard"), F.xxhash64(F.lit(seed + 2), "rid").alias("k"))
    sent = written(sent.withColumn("block", F.shiftrightunsigned("k", 64 - bits)), "shards")
    blocks = sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("shard", "block", (F.sum("n").over(W.partitionBy("shard").orderBy("block")) - F.col("n")).alias("before"))
    at = F.row_number().over(W.partitionBy("shard", "block").orderBy(F.shiftleft("k", bits), "rid"))
    slots = written(sent.withColumn("at", at).join(blocks, ["shard", "block"]).select(F.col("rid").alias(rid), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot")), "slots")
    discard(rows, matrix, sent)
    # the exchange: rows move at every size, as a merge join does; a broadcast of the slots would leave them where they are
    return whole.join(slots.hint("merge"), rid).drop(rid)


def op4_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents"), "doc_id")
    body = text_of(out).cast("binary")
    size = (F.octet_length(body) + 16).cast("long")
    return out.select("doc_id", size.alias("size"), F.crc32(body).alias("text_crc32"), F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
