"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter holds all languages: a slot is a bit mask with one bit for each language, an n-gram
sets its language's bit in ``HASHES`` slots, and the AND of the slots gives all languages that
hold the n-gram (with false positives at a rate known from the filter's fill). A text is scored
by counting, for each language, the n-grams whose mask has its bit; the expected false positives
are taken off, and the language with the highest corrected share wins (ties: the smaller name).

A language's n-grams are those of its training texts that occur in the largest numbers of texts,
at most ``PROFILE`` for each length. The filter is fitted on a bounded sample: at most ``SAMPLE``
labelled texts of each language, those with the smallest hashes; a group of copies counts once.
A mask holds 64 languages; more take further masks of ``2 ** SLOT_BITS`` slots (2 MiB each), so
the filter grows with the number of languages and not with the input.

Letters are code points of the Unicode categories L. Edge cases: null text, or one without
letters, is ``und`` with score 0; with no training rows every text is ``und``; a null language
is no training row, null text trains nothing; repeated rows get equal results and train once;
long texts are read whole, a window of n-grams at a time; an empty table gives no rows; columns
other than those named are not read, or (in ``accepted``) pass through whatever their names.
"""

from __future__ import annotations

import math
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, lean, table, written
from .encoder import SLICE, slices

LENGTHS = (2, 3, 4)
PROFILE, SAMPLE = 4000, 2000
SLOT_BITS, HASHES = 18, 3
#: Salts over which the n-grams of one language are first ranked.
SALTS = 16
#: N-grams that are looked up at once.
WINDOW = 1 << 18
#: How fast the score rises with the winner's lead in n-grams.
CERTAINTY = 0.2
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


def folded(text: str) -> np.ndarray:
    """Code points of the text in lower case, every run of non-letters as one blank, a blank at both ends; empty without letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[x]
    if not letter.any():
        return np.empty(0, dtype="uint32")
    x = np.concatenate([[np.uint32(32)], np.where(letter, x, np.uint32(32)), [np.uint32(32)]]).astype("uint32")
    blank = x == 32
    return x[~(blank & np.concatenate([[False], blank[:-1]]))]


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of folded code points."""
    if len(x) < n:
        return np.empty(0, dtype="uint64")
    x = x.astype("uint64")
    with np.errstate(over="ignore"):
        h = np.full(len(x) - n + 1, 0x9E3779B97F4A7C15 + n, dtype="uint64")
        for j in range(n):
            h = (h ^ x[j : j + len(h)]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


def _windows(x: np.ndarray, n: int):
    """The n-grams of folded code points, a window at a time."""
    for i in range(0, max(1, len(x) - n + 1), WINDOW):
        yield grams(x[i : i + WINDOW + n - 1], n)


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th slot of each hash."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64((0x94D049BB133111EB + 2 * k * 0x1F123BB5) | 1)) >> np.uint64(64 - SLOT_BITS)).astype("int64")


class Filter:
    """The bit-sliced filter; ``profiles`` maps a language to its n-gram hashes."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.languages = sorted(profiles)
        self.slots = np.zeros((-(-len(self.languages) // 64), 1 << SLOT_BITS), dtype="uint64")
        for i, lang in enumerate(self.languages):
            for k in range(HASHES):
                np.bitwise_or.at(self.slots[i // 64], _slots(profiles[lang], k), np.uint64(1 << i % 64))
        fill = [np.count_nonzero(self.slots[i // 64] & np.uint64(1 << i % 64)) / (1 << SLOT_BITS) for i in range(len(self.languages))]
        self.false = np.array(fill) ** HASHES

    def shares(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Corrected share of the n-grams of folded code points that each language holds, and their number."""
        hits, total = np.zeros(len(self.languages)), 0
        for n in LENGTHS:
            for h in _windows(x, n):
                total += len(h)
                at = [_slots(h, k) for k in range(HASHES)]
                for s, slots in enumerate(self.slots):
                    mask = slots[at[0]]
                    for a in at[1:]:
                        mask &= slots[a]
                    for i in range(64 * s, min(64 * s + 64, len(self.languages))):
                        hits[i] += np.count_nonzero(mask & np.uint64(1 << i % 64))
        if not total:
            return hits, 0
        return np.clip((hits / total - self.false) / (1 - self.false), 0, 1), total

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (the winner's share, less where its lead over the next is few n-grams), and the winner's share."""
        x = folded(text or "")
        if not len(x) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        s, n = self.shares(x)
        i = int(np.argmax(s))
        lead = n * float(s[i] - max(np.delete(s, i), default=0.0))
        return self.languages[i], float(s[i]) / (1 + math.exp(-CERTAINTY * min(lead, 1e3))), float(s[i])


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _sampled(known: DataFrame, sample: int) -> DataFrame:
    """lang, most: the hash of the last text of each language's sample. known: lang, h, text."""
    hashes = written(known.select("lang", "h").distinct(), "hashes")
    # a language's counts by ranges of hashes (at most 65,536) tell which hold its sample, so that no task sorts a language
    bits = min(16, max(1, math.ceil(math.log2(max(1, hashes.count()) / sample)) + 3))
    place = F.shiftright("h", 64 - bits)
    ranges = hashes.groupBy("lang", place.alias("r")).agg(F.count(F.lit(1)).alias("c"))
    upto = ranges.withColumn("before", F.sum("c").over(W.partitionBy("lang").orderBy("r")) - F.col("c"))
    last = upto.where(F.col("before") < sample).groupBy("lang").agg(F.max("r").alias("last"))
    few = hashes.join(F.broadcast(last), "lang").where(place <= F.col("last"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    most = written(few.withColumn("place", place).where(F.col("place") <= sample).groupBy("lang").agg(F.max("h").alias("most")), "bounds")
    discard(hashes)
    return most


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, profile: int = PROFILE) -> Filter:
    """Fit on labelled rows. Only the n-gram profiles, of bounded size for each language, reach the driver."""
    known = rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    bounds = _sampled(known, sample)
    # one row a language, of which the model on the driver holds far more
    texts = known.join(F.broadcast(bounds), "lang").where("h <= most").dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    x = folded(t)
                    for n in LENGTHS:
                        g = np.unique(grams(x, n))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array([n] * len(g), pa.int32()), pa.array(g.view("int64"))], ["lang", "n", "g"])

    counts = texts.mapInArrow(lean(count), "lang string, n int, g long").groupBy("lang", "n", "g").agg(F.count(F.lit(1)).alias("df"))
    salt = F.pmod("g", F.lit(SALTS))
    order = [F.desc("df"), "g"]
    best = counts.withColumn("place", F.row_number().over(W.partitionBy("lang", "n", salt).orderBy(*order))).where(F.col("place") <= profile)
    best = best.withColumn("place", F.row_number().over(W.partitionBy("lang", "n").orderBy(*order))).where(F.col("place") <= profile)
    profiles: dict[str, list[int]] = {}
    for row in best.select("lang", "g").collect():
        profiles.setdefault(row["lang"], []).append(row["g"])
    discard(bounds)
    return Filter({k: np.array(v, dtype="int64").view("uint64") for k, v in profiles.items()})


def identify(docs: DataFrame, model: Filter, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score, share of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        m = shared.value
        for b in (s for batch in batches for s in slices(batch, 1, SLICE)):
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64())], ["key", "lang_pred", "score", "share"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(lean(predict), "key long, lang_pred string, score double, share double").withColumnRenamed("key", key)


def accepted(docs: DataFrame, model: Filter, least_share: float, text: str = "text") -> DataFrame:
    """The rows whose text is in a known language: not ``und``, and at least ``least_share`` of its n-grams the winner's.

    Rows pass through unchanged. A model without languages rejects nothing but texts without letters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches):
        m = shared.value
        for b in (s for batch in batches for s in slices(batch, at, SLICE)):
            known = []
            for t in b.column(at).to_pylist():
                lang, _, share = m.predict(t)
                known.append(len(folded(t or "")) > 0 if not m.languages else lang != UNKNOWN and share >= least_share)
            yield b.filter(pa.array(known, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)


def op7_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~is_held_out(F.col("doc_id"))))
    return identify(docs, model).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
