"""Near-duplicate documents: MinHash bands, verified links, connected components.

A document is the set of its distinct word shingles (ASCII lower case, white-space words).
Documents with equal sets form one class; classes are the vertices.

1. Each set gets ``BANDS * ROWS`` minima of multiply-shift hashes; each band of ``ROWS`` minima
   is a bucket key. Two sets of Jaccard similarity 0.8 share no bucket with a probability of
   (1 - 0.8 ** ROWS) ** BANDS, about 1e-7.
2. First round: in each bucket every set is paired with the bucket's smallest id only. Pairs
   whose signatures (a byte of each minimum) agree far too rarely are dropped, the others are
   verified on the full sets, and links are joined into components by alternating large-star
   and small-star.
3. Second round, only for buckets that still hold several components: every pair of sets of
   different components is compared, so that no link between components is lost. Small buckets
   give pairs to a join; larger ones are compared block by block inside tasks, which return
   the links that join components, not the pairs. No pair within one component is compared.

Edge cases: null, empty or blank text has no shingles and links with nothing; a text with
fewer words than a shingle is one shingle; rows that repeat a key with other texts are documents
of their own (a component has the smallest key of any of its rows); a null key has a null
component, joins no class and is neither kept nor dropped by ``deduplicated``'s rule but stays;
equal rows are one document; long texts are read whole; an empty table gives no rows; columns
may have any names.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, own_names, release, table, text_of, written
from .encoder import SLICE, slices

WORDS, THRESHOLD = 2, 80
BANDS, ROWS, SEED = 40, 5, 17
#: Buckets up to this size give their pairs to a join in the second round.
SMALL_BUCKET = 16
#: Sets of larger buckets that one task compares with as many others.
BLOCK = 1024
#: Standard errors below the threshold at which a signature rules a pair out.
MARGIN = 6.0
#: Positions of the bit set of keys that spares a shuffle of texts: sixteen a key, between these (128 KiB and 32 MiB).
KEY_BITS = (1 << 20, 1 << 28)
#: Rows of one class (or component) that one task of a join takes; at most 1,000 classes hold more.
SAME = 10_000


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts, with a bounded cache of the hashes of short words."""

    CACHE, SHORT = 100_000, 24

    def __init__(self, words: int):
        self.words, self.seen = words, {}
        rng = random.Random(SEED)
        self.mult = [np.uint64(rng.getrandbits(64) | 1) for _ in range(words)]

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        found = list(map(seen.get, words))
        if None in found:
            room = len(seen) < self.CACHE
            for i, h in enumerate(found):
                if h is None:
                    h = found[i] = xxhash.xxh64_intdigest(words[i])
                    if room and len(words[i]) <= self.SHORT:
                        seen[words[i]] = h
        return np.array(found, dtype="uint64")

    def shingles(self, text: str) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype="uint64")
        h = self._hashes(words)
        k = min(self.words, len(h))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - k + 1, 0x9E3779B97F4A7C15 + k, dtype="uint64")
            for j in range(k):
                out = (out ^ h[j : j + len(out)]) * self.mult[j]
                out ^= out >> np.uint64(29)
        return np.unique(out)

    def sets(self, texts: pa.Array) -> tuple[list[np.ndarray], list[pa.Array]]:
        """The sets of some texts, and the halves of their 128-bit hashes."""
        found = [self.shingles(t) for t in texts.to_pylist()]
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
        return found, [pa.array([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests], pa.int64()) for i in (0, 8)]


class Minima:
    """Minima of universal (multiply-shift) hashes of a set of 64-bit values."""

    def __init__(self, n: int, seed: int = SEED):
        rng = random.Random(seed + 1)
        self.a = np.array([rng.getrandbits(32) | 1 for _ in range(n)], dtype="uint32")
        self.b = np.array([rng.getrandbits(32) for _ in range(n)], dtype="uint32")

    def of(self, values: np.ndarray) -> np.ndarray:
        x = ((values >> np.uint64(32)) ^ values).astype("uint32")
        best = np.full(len(self.a), 0xFFFFFFFF, dtype="uint32")
        for i in range(0, len(x), 512):
            h = x[i : i + 512, None] * self.a
            h += self.b
            np.minimum(best, h.min(axis=0), out=best)
        return best


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n, h1, h2 (hash of the set), bands array<long>, sig binary, of every row; written."""

    def sketch(batches):
        shingler, minima = Shingler(words), Minima(bands * rows)
        for batch in batches:
            for b in slices(batch, 1, SLICE):
                sets, halves = shingler.sets(b.column(1))
                found = [minima.of(s) for s in sets]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype="int32") * bands), pa.array(np.concatenate([band_keys(m, rows) for m in found])))
                sigs = pa.array([(m >> np.uint32(24)).astype("uint8").tobytes() for m in found], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), *halves, keys, sigs], ["key", "n", "h1", "h2", "bands", "sig"])

    plain = docs.select(F.col(key).cast("long").alias("key"), text_of(docs, text).alias("text"))
    return written(plain.mapInArrow(lean(sketch), "key long, n long, h1 long, h2 long, bands array<long>, sig binary"), "sketches")


def band_keys(minima: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit bucket key for each band of minima."""
    m = minima.reshape(-1, rows).astype("uint64")
    with np.errstate(over="ignore"):
        out = np.arange(1, len(m) + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
        for j in range(rows):
            out = (out ^ m[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(31)
    return out.view("int64")


def key_bits(keys: DataFrame, n: int):
    """A broadcast bit set, of bounded size, of the column ``key`` of about ``n`` rows."""
    size = min(KEY_BITS[1], max(KEY_BITS[0], 1 << (16 * n).bit_length()))
    at = F.pmod(F.xxhash64("key"), F.lit(size))
    packed = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    bits = np.zeros(size // 64, dtype="int64")
    got = packed.toArrow()  # at most size / 64 rows
    bits[got["w"].to_numpy()] = got["b"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(bits)


def may_hold(bits, hashes: np.ndarray) -> np.ndarray:
    """Whether each key, by its xxhash64, may be in the set; never false for one that is."""
    at = np.mod(hashes, 64 * len(bits.value))
    return (bits.value[at >> 6] >> (at & 63)) & 1 == 1


def shingle_sets(docs: DataFrame, key: str, text: str, words: int, bits) -> DataFrame:
    """h1, h2, set array<long> of the documents whose key may be in ``bits``; no text is shuffled."""

    def sets(batches):
        shingler = Shingler(words)
        for batch in batches:
            held = pa.array(may_hold(bits, batch.column(0).to_numpy()))
            for b in slices(batch.filter(held), 1, SLICE):
                found, halves = shingler.sets(b.column(1))
                yield pa.RecordBatch.from_arrays([*halves, pa.array([s.view("int64") for s in found], pa.list_(pa.int64()))], ["h1", "h2", "set"])

    plain = docs.select(F.xxhash64(F.col(key).cast("long")).alias("hash"), text_of(docs, text).alias("text"))
    return plain.mapInArrow(lean(sets), "h1 long, h2 long, set array<long>")


def _agreeing(bands: int, rows: int, threshold: int) -> int:
    """Least number of equal signature bytes of a pair that may be a link."""
    s, n = threshold / 100, bands * rows
    return int(n * s - MARGIN * (n * s * (1 - s)) ** 0.5)


def linked(i: Column, a: Column, b: Column, threshold: int) -> Column:
    return 100 * i >= threshold * (a + b - i)


def _verified(pairs: DataFrame, classes: DataFrame, sets_of, least: int, threshold: int) -> DataFrame:
    """u, v of the pairs that are links; written. Signatures first, then full sets of what is left."""
    sig = classes.select("cid", "sig")
    both = pairs.join(sig.select(F.col("cid").alias("u"), F.col("sig").alias("us")), "u").join(sig.select(F.col("cid").alias("v"), F.col("sig").alias("vs")), "v")
    both = written(both.where(_equal_bytes("us", "vs") >= least).select("u", "v"), "pairs")
    sets = sets_of(both.select(F.col("u").alias("cid")).union(both.select(F.col("v").alias("cid"))).distinct())
    full = both.join(sets.select(F.col("cid").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("cid").alias("v"), F.col("set").alias("b")), "v")
    i = F.size(F.array_intersect("a", "b")).cast("long")
    links = written(full.where(linked(i, F.size("a").cast("long"), F.size("b").cast("long"), threshold)).select("u", "v").distinct(), "links")
    discard(both, sets)
    return links


def _equal_bytes(a: str, b: str) -> Column:
    """How many bytes of two signatures of one length are equal."""

    @F.arrow_udf("int")
    def count(a: pa.Array, b: pa.Array) -> pa.Array:
        if not len(a):
            return pa.array([], pa.int32())
        x, y = (np.frombuffer(b"".join(s.to_pylist()), "u1").reshape(len(s), -1) for s in (a, b))
        return pa.array((x == y).sum(axis=1, dtype="int32"))

    return count(F.col(a), F.col(b))


def _unsettled(edges: DataFrame) -> DataFrame:
    """Ends of distinct edges (u > v) that keep them from being stars: larger ends of several edges, or of one and smaller of another.

    With none, every edge goes from a vertex without others to its star's smallest.
    """
    ends = edges.select(F.col("u").alias("k"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("k").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """key, component (smallest key reachable) of every end of a link (u, v), by large-star and small-star."""
    edges = written(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(limit):
        if not _unsettled(edges).limit(1).count():
            out = edges.select(F.col("u").alias("key"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct())
            out._millrace_path = edges._millrace_path
            return out
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # a row for each edge at most; what repeats goes after the small stars
        large = written(both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = written(small, "edges")
        discard(edges, large)
        edges = small
    raise RuntimeError("components did not settle")


class Shared:
    """Bounds of how many elements sets of one list share with sets of another, many pairs at once.

    A set's elements mark positions of a table by their hashes' top bits, and another set's elements
    on marked positions are never fewer than those shared: equal elements have equal positions.
    """

    #: Positions of the table for each element of the largest set, and their bounds in bits; elements looked up at once.
    ROOM, BITS, AT_ONCE = 64, (16, 24), 1 << 20

    def __init__(self, sets: list[np.ndarray], rest: list[np.ndarray]):
        bits = min(self.BITS[1], max(self.BITS[0], (self.ROOM * max(map(len, sets), default=0)).bit_length()))
        self.marks, self.shift, self.sets, self.rest = np.zeros(1 << bits, dtype="u1"), np.uint64(64 - bits), sets, [self._places(x, bits) for x in rest]
        self.sizes = np.array([len(x) for x in rest], dtype="int64")

    def _places(self, x: np.ndarray, bits: int) -> np.ndarray:
        return (x.view("uint64") >> np.uint64(64 - bits)).astype("uint32")

    def most(self, k: int, among: np.ndarray) -> np.ndarray:
        """No less than the number of elements that set ``k`` shares with each (non-empty) set of ``among``."""
        own = (self.sets[k].view("uint64") >> self.shift).astype("uint32")
        self.marks[own] = 1
        out, ends, i = np.empty(len(among), dtype="int64"), np.cumsum(self.sizes[among]), 0
        while i < len(among):
            before = int(ends[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(ends, before + self.AT_ONCE, "right")))
            found = self.marks[np.concatenate([self.rest[m] for m in among[i:j].tolist()])]
            out[i:j] = np.add.reduceat(found, np.concatenate([[0], ends[i : j - 1] - before]).astype("int64"), dtype="int64")
            i = j
        self.marks[own] = 0
        return np.minimum(out, len(self.sets[k]))

    def may_link(self, k: int, among: np.ndarray, threshold: int) -> np.ndarray:
        """Whether set ``k`` and each set of ``among`` may be a link; never false for one that is."""
        i = self.most(k, among)
        return 100 * i >= threshold * (len(self.sets[k]) + self.sizes[among] - i)


def _open_pairs(opened: DataFrame) -> DataFrame:
    """Pairs of different components in small open buckets."""
    a = opened.select("b", F.col("cid").alias("u"), F.col("component").alias("cu"))
    z = opened.select("b", F.col("cid").alias("v"), F.col("component").alias("cv"))
    return a.join(z, "b").where((F.col("u") < F.col("v")) & (F.col("cu") != F.col("cv"))).select("u", "v").distinct()


def _open_blocks(opened: DataFrame, least: int, threshold: int) -> DataFrame:
    """Links between components in larger open buckets. opened: b, cid, component, c (bucket size), sig, set."""
    g = F.ceil(F.col("c") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cid"), g).cast("int")
    # every pair of blocks meets in one task
    spread = opened.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), g - 1)))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "c")

    def side(t: pa.Table):
        sets, sig = t["set"].combine_chunks(), np.frombuffer(b"".join(t["sig"].to_pylist()), "u1").reshape(t.num_rows, -1)
        ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
        return t["cid"].to_pylist(), t["component"].to_numpy(), sig, [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def compare(t: pa.Table) -> pa.Table:
        first = t.filter(pa.compute.equal(t["own"], t["i"]))
        second = t.filter(pa.compute.equal(t["own"], t["j"]))
        out = []
        if first.num_rows and second.num_rows:
            parent: dict[int, int] = {}

            def root(x):
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            (ids, own, sigs, sets), (others, comp, more, rest) = side(first), side(second)
            shared, same = Shared(sets, rest), t["i"][0] == t["j"][0]
            for k in range(len(ids)):
                # a block meets itself with each pair once
                begin = k + 1 if same else 0
                agree = (more[begin:] == sigs[k]).sum(axis=1)
                hopeful = np.flatnonzero((agree >= least) & (comp[begin:] != own[k]))
                hopeful = begin + hopeful[np.argsort(-agree[hopeful], kind="stable")]
                for m in hopeful[shared.may_link(k, hopeful, threshold)].tolist():
                    a, z = root(int(own[k])), root(int(comp[m]))
                    if a == z:
                        continue
                    x, y = sets[k], rest[m]
                    i = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * i >= threshold * (len(x) + len(y) - i):
                        parent[a] = z
                        out.append((ids[k], others[m]))
        release()
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return spread.groupBy("b", "i", "j").applyInArrow(compare, "u long, v long")


def _spread_join(left: DataFrame, right: DataFrame, on: list[str], spread: Column, total: int) -> DataFrame:
    """``left`` left-joined with ``right`` (one row a key, with ``c``, the key's rows): what many rows share meets them in several tasks."""
    limit = max(SAME, total // 1000)
    hot = F.broadcast(right.where(F.col("c") > limit).select(*on, F.ceil(F.col("c") / limit).cast("int").alias("g")))  # below 1,000 rows
    g = F.coalesce("g", F.lit(1))
    a = left.join(hot, on, "left").withColumn("s", F.pmod(F.xxhash64(spread), g).cast("int")).drop("g")
    b = right.join(hot, on, "left").withColumn("s", F.explode(F.sequence(F.lit(0), g - 1))).drop("g", "c")
    return a.join(b, [*on, "s"], "left").drop("s")


def labelled(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """key, n, h1, h2, component_id, first (of its component's classes, the one that is kept) of every row of ``docs``."""
    sk = sketches(docs, key, text, words, bands, rows)
    least = _agreeing(bands, rows, threshold)
    some = sk.where((F.col("n") > 0) & F.col("key").isNotNull())
    # equal sets have equal bands and signatures; ids are fixed once written
    classes = some.groupBy("h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("c"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    buckets = classes.select("cid", F.explode("bands").alias("b"))
    sizes = buckets.groupBy("b").agg(F.min("cid").alias("m"), F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = written(buckets.join(sizes, "b"), "buckets")

    def sets_of(ids: DataFrame) -> DataFrame:
        """cid, set; written."""
        wanted = written(classes.select("cid", "rep", "h1", "h2").join(ids, "cid", "left_semi"), "wanted")
        found = shingle_sets(docs, key, text, words, key_bits(wanted.select(F.col("rep").alias("key")), wanted.count()))
        # copies of a wanted text that share its key's position give the set again
        out = written(found.join(wanted, ["h1", "h2"]).groupBy("cid").agg(F.first("set").alias("set")), "sets")
        discard(wanted)
        return out

    stars = shared.where("cid <> m").select(F.col("m").alias("u"), F.col("cid").alias("v")).distinct()
    links = _verified(stars, classes, sets_of, least, threshold)
    found = components(links)

    named = written(shared.join(found.withColumnRenamed("key", "cid"), "cid", "left").select("b", "cid", "c", F.coalesce("component", "cid").alias("component")), "named")
    still = named.groupBy("b").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("b")
    opened = written(named.join(still, "b", "left_semi"), "open")
    pairs = _open_pairs(opened.where(F.col("c") <= SMALL_BUCKET)).join(stars, ["u", "v"], "left_anti")
    used = [named, shared, opened, links, found, _verified(pairs, classes, sets_of, least, threshold)]
    more = used[-1]
    large = opened.where(F.col("c") > SMALL_BUCKET)
    if large.limit(1).count():
        sets = sets_of(large.select("cid").distinct())
        full = large.join(classes.select("cid", "sig"), "cid").join(sets, "cid")
        blocks = written(_open_blocks(full, least, threshold), "links")
        used += [sets, blocks]
        more = more.union(blocks)
    if more.limit(1).count():
        found = components(links.union(more))
        used.append(found)
    # a component's label is the smallest key of its classes, of those that have it the one with the smallest hash
    member = classes.select("cid", "rep", "h1", "h2", "c").join(found.withColumnRenamed("key", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    member = written(member, "members")
    label = member.groupBy("component").agg(F.min(F.struct("rep", "h1", "h2")).alias("l"), F.count(F.lit(1)).alias("c"))
    label = label.select("component", F.col("l.rep").alias("component_id"), F.struct("l.h1", "l.h2").alias("top"), "c")
    total = member.count()
    vertices = _spread_join(member.withColumnRenamed("c", "size"), label, ["component"], F.col("cid"), total)
    vertices = written(vertices.select("h1", "h2", F.col("size").alias("c"), "component_id", (F.col("top") == F.struct("h1", "h2")).alias("first")), "vertices")
    slim = written(sk.select("key", "n", "h1", "h2"), "rows")
    discard(sk, classes, member, *used)
    out = _spread_join(slim, vertices, ["h1", "h2"], F.col("key"), slim.count())
    own = F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("component_id")).otherwise(F.col("key"))
    return out.select("key", "n", "h1", "h2", own.alias("component_id"), F.coalesce("first", F.lit(False)).alias("first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_shingles, component_id, kept for every row of ``docs``."""
    out = labelled(docs, key, text, **options)
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", (F.col("component_id") == F.col("key")).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, **options) -> DataFrame:
    """One row of each component (its smallest key, of equal rows one); rows without words and those without a key stay.

    Rows whose key may be among those that go, or that repeat, are shingled again and meet the
    list by key and set; the others pass without a shuffle.
    """
    rows = labelled(docs, key, text, words, **options).where((F.col("n") > 0) & F.col("key").isNotNull())
    stays = F.col("first") & (F.col("key") == F.col("component_id"))
    marks = rows.groupBy("key", "h1", "h2").agg(F.bool_or(stays).alias("stays"), F.count(F.lit(1)).alias("c"))
    marks = written(marks.where("not stays or c > 1"), "marks")
    gone = marks.where("not stays")
    bits = key_bits(marks.select("key"), marks.count())
    at, suspect, n, h1, h2 = docs.columns.index(text), *own_names(docs, "suspect", "n", "h1", "h2")

    @F.arrow_udf("boolean")
    def held(hashes: pa.Array) -> pa.Array:
        return pa.array(may_hold(bits, hashes.to_numpy()))

    def hashed(batches):
        shingler = Shingler(words)
        for batch in batches:
            for b in slices(batch, at, SLICE):
                sets, halves = shingler.sets(b.column(at).fill_null(""))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(s) for s in sets], pa.int64()), *halves], [*b.schema.names, n, h1, h2])

    whole = F.col(f"`{key}`").cast("long")
    marked = docs.withColumn(suspect, held(F.xxhash64(whole)) & whole.isNotNull())
    clear = marked.where(~F.col(suspect)).drop(suspect)
    kind = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in (n, h1, h2))])
    again = marked.where(F.col(suspect)).drop(suspect).mapInArrow(lean(hashed), kind)
    plain = [F.col(f"`{c}`") for c in docs.columns]
    blank = again.where(F.col(n) == 0).select(*plain)
    once = again.where(F.col(n) > 0).dropDuplicates([key, h1, h2])
    g = gone.select(F.col("key").alias("gone_key"), F.col("h1").alias("gone_h1"), F.col("h2").alias("gone_h2"))
    left = once.alias("d").join(g.alias("g"), (F.col(f"d.`{key}`").cast("long") == F.col("g.gone_key")) & (F.col(f"d.`{h1}`") == F.col("g.gone_h1")) & (F.col(f"d.`{h2}`") == F.col("g.gone_h2")), "left_anti")
    return clear.unionByName(blank).unionByName(left.select(*plain))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
