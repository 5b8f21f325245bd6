"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

Candidates of the models are runs of 16 or more of ``[A-Za-z0-9+/_=-]`` in the text without its
pattern matches, so what is left of a run beside a match is a candidate of its own. One
first-order model is trained on random strings, one on ordinary identifiers; a candidate is a
secret where the first model's log-likelihood exceeds the second's by ``threshold`` nats for
each transition.

Training rows are (sample, random). By default, values of pattern matches anywhere in the corpus
and ``DRAWN`` strings drawn from digests (base64 and hexadecimal) are labelled random; words of
12 or more letters, ``_`` and ``-`` anywhere in the corpus outside pattern matches, as they are
and in capitals, and
``DRAWN`` each of dates, numbered names, paths and rules, are labelled ordinary. Only transition
counts between character classes (one for each of the 66 characters and one for all others)
leave the rows: at most 2 * 67 * 67 sums at any corpus size, which are what the driver gets.

Positions are code points, ends exclusive. Edge cases: null text is the empty text; a text
without matches has counts of 0 and the hash of the empty string; with no training rows of
one kind that model is uniform, and with none of both nothing is added; spans that start at one
place are ordered by kind; repeated rows get equal results; long texts and long candidates are
read whole, candidates in overlapping pieces; an empty table gives no rows; the two added columns
are named by parameters, and a column that has such a name is an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, table, text_of

#: Pattern, the group whose length counts, and the least length. Order is the order of kinds.
PATTERNS = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 18),
    "hex": (r"([0-9a-f]{16,})", 1, 16),
}
#: Cheap tests that every text with a match passes.
HINTS = {"assign": r"[dDtTnNyY][\"']?\x20*[:=]", "access": "AKIA", "hex": r"[0-9a-f]{16}"}
CANDIDATE = r"([A-Za-z0-9+/_=-]{16,})"
ORDINARY = r"([A-Za-z_-]{12,})"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Nats a transition. Of strings held out, ordinary ones scored below 1.2, random ones above 2.1 (0.5 % below 2.2).
THRESHOLD = 1.5
#: Drawn strings of each form among the default training rows.
DRAWN = 2000
#: Transitions that are counted or added up at a time.
PIECE = 4096
#: Weight of single-character shares in a transition's estimate, and what each character's count starts from.
PRIOR, SMOOTH = 10.0, 1.0
KINDS = (*PATTERNS, "markov")
SPAN = "array<struct<start:int,k:int,end:int>>"


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(text: str, pattern: str, group: int, least: int, k: int, hint: str) -> str:
    """SQL for the spans of one kind: what lies between matches gives their places."""
    p, t = _sql(pattern), text
    all_of = lambda g: f"regexp_extract_all({t}, {p}, {g})"
    pairs = f"zip_with({all_of(1)}, {all_of(group)}, (m, v) -> named_struct('m', m, 'v', v))"
    # the last piece has no match after it
    found = f"filter(zip_with(split({t}, {p}, -1), {pairs}, (a, y) -> named_struct('a', a, 'm', y.m, 'v', y.v)), x -> x.m is not null)"
    step = "named_struct('at', s.at + length(x.a) + length(x.m), 'out', if(length(x.v) >= %d, concat(s.out, array(named_struct('start', s.at + length(x.a), 'k', %d, 'end', s.at + length(x.a) + length(x.m)))), s.out))" % (least, k)
    return f"if({t} rlike {_sql(hint)}, aggregate({found}, named_struct('at', 0, 'out', cast(array() as {SPAN})), (s, x) -> {step}, s -> s.out), cast(array() as {SPAN}))"


def base_spans(df: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """Add the pattern matches, sorted by start, then kind."""
    parts = [_spans(f"`{text}`", *spec, k, HINTS[kind]) for k, (kind, spec) in enumerate(PATTERNS.items())]
    return df.withColumn(out, F.expr(f"array_sort(concat({', '.join(parts)}))"))


def _pieces(word: str) -> str:
    """SQL for a word in pieces that share one character with the next, so that each transition is in one."""
    return f"regexp_extract_all({word}, '(?s)(?=(.{{1,{PIECE + 1}}})).{{1,{PIECE}}}', 1)"


def _codes(piece: str) -> str:
    """SQL for a piece's character classes: the place in ALPHABET from 1, or 0."""
    return f"transform(split({piece}, ''), c -> instr({_sql(ALPHABET)}, c))"


def without(text: str) -> str:
    """SQL for the text with every pattern match blanked, each character by a blank, so that places stay."""
    for pattern, group, least in PATTERNS.values():
        p, all_of = _sql(pattern), lambda g, t=text, p=_sql(pattern): f"regexp_extract_all({t}, {p}, {g})"
        pairs = f"zip_with({all_of(1)}, {all_of(group)}, (m, v) -> if(length(v) >= {least}, repeat(' ', length(m)), m))"
        text = f"array_join(zip_with(split({text}, {p}, -1), {pairs}, (a, m) -> concat(a, coalesce(m, ''))), '')"
    return text


def samples(df: DataFrame, text: str = "text", base: str = "base") -> DataFrame:
    """Labelled training rows (sample, random) of a table that base_spans() has been through."""
    value = F.expr(f"transform({base}, x -> named_struct('k', x.k, 's', substring(`{text}`, x.start + 1, x.end - x.start)))")
    random = df.where(F.size(base) > 0).select(F.explode(value).alias("x")).select(F.col("x.k").alias("k"), F.col("x.s").alias("s"))
    # of an assignment, the value only
    pattern, group, _ = PATTERNS["assign"]
    random = random.select(F.when(F.col("k") == 0, F.regexp_extract("s", pattern, group)).otherwise(F.col("s")).alias("sample"), F.lit(True).alias("random"))
    hidden = F.when(F.size(base) > 0, F.expr(without(f"`{text}`"))).otherwise(F.col(f"`{text}`"))
    plain = df.where(F.col(f"`{text}`").rlike(ORDINARY)).select(F.explode(F.regexp_extract_all(hidden, F.lit(ORDINARY))).alias("w"))
    plain = plain.select(F.explode(F.array("w", F.upper("w"))).alias("sample"), F.lit(False).alias("random"))
    return random.unionByName(plain).unionByName(drawn(df.sparkSession))


def drawn(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """Random strings, labelled so: base64 and hexadecimal of digests. Ordinary ones: dates, numbered names, paths and rules."""
    rows = spark.range(n).withColumn("d", F.sha2(F.col("id").cast("string").cast("binary"), 256))
    random = F.array(F.rtrim(F.base64(F.unhex("d")), F.lit("=")), F.substring("d", 1, 40))
    day = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int") * 5), "yyyy-MM-dd")
    number = F.col("id").cast("string")
    ordinary = F.array(
        day, F.concat(day, F.lit("_"), number), F.concat(F.lit("version-"), number, F.lit("-release")), F.concat(F.lit("section_"), number, F.lit("_part")), F.concat(F.lit("docs/"), number, F.lit("/images/")),
        F.concat(F.lit("name=value"), number), *[F.repeat(F.lit(c), 20) for c in "-=_+/"],
    )
    kinds = [rows.select(F.explode(c).alias("sample"), F.lit(k).alias("random")) for c, k in ((random, True), (ordinary, False))]
    return kinds[0].unionByName(kinds[1])


def train(rows: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios of transitions between character classes, each model smoothed by its own single-character shares."""
    pieces = rows.where(F.length("sample") > 1).select("random", F.explode(F.expr(_pieces("sample"))).alias("piece")).where(F.length("piece") > 1)
    codes = pieces.select("random", F.expr(_codes("piece")).alias("c"))
    pairs = codes.select("random", F.explode(F.expr("transform(sequence(1, size(c) - 1), i -> c[i - 1] * 128 + c[i])")).alias("p"))
    counts = pairs.groupBy("random", "p").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * 67 * 67 rows
    n = len(ALPHABET) + 1
    tables = {kind: [[0.0] * n for _ in range(n)] for kind in (True, False)}
    for row in counts:
        tables[row["random"]][row["p"] // 128][row["p"] % 128] += row["n"]
    for t in tables.values():
        single = [sum(line[b] for line in t) + SMOOTH for b in range(n)]
        whole = sum(single)
        for line in t:
            total = sum(line)
            line[:] = [math.log((x + PRIOR * s / whole) / (total + PRIOR)) for x, s in zip(line, single, strict=True)]
    return [[a - b for a, b in zip(x, y, strict=True)] for x, y in zip(tables[True], tables[False], strict=True)]


def all_spans(df: DataFrame, model: list[list[float]], text: str = "text", base: str = "base", out: str = "spans", threshold: float = THRESHOLD) -> DataFrame:
    """Add the pattern matches and the model's spans, sorted by start, then kind."""
    n, t, k = len(model), f"`{text}`", len(PATTERNS)
    hidden, found = own_names(df, "hidden", "found")
    flat = "array(" + ",".join(f"{x:.6f}D" for line in model for x in line) + ")"
    hint = "[A-Za-z0-9+/_=-]{16}"
    masked = df.withColumn(hidden, F.when(~F.col(text).rlike(hint), F.lit("")).when(F.size(base) > 0, F.expr(without(t))).otherwise(F.col(text)))
    candidates = masked.withColumn(found, F.expr(_spans(f"`{hidden}`", CANDIDATE, 1, 16, k, hint)))
    word = f"substring(`{hidden}`, x.start + 1, x.end - x.start)"
    # a match that another cuts short may leave a piece of itself
    free = f"not exists({base}, y -> y.start < x.end and x.start < y.end)"
    piece = f"transform(array({_codes('p')}), q -> if(size(q) < 2, 0D, aggregate(sequence(1, size(q) - 1), 0D, (s, i) -> s + {flat}[q[i - 1] * {n} + q[i]])))[0]"
    scored = f"filter({found}, x -> {free} and aggregate({_pieces(word)}, 0D, (a, p) -> a + {piece}) > {threshold} * (x.end - x.start - 1))"
    # rows without candidates never reach the model
    spans = F.when(F.size(found) > 0, F.expr(f"array_sort(concat({base}, {scored}))")).otherwise(F.col(base))
    return candidates.withColumn(out, spans).drop(hidden, found)


def joined(spans: str) -> Column:
    names = "element_at(array(" + ",".join(f"'{k}'" for k in KINDS) + "), x.k + 1)"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}, ':', x.start, ':', x.end)), ',')")


def redacted(text: str, spans: str, mark: str = "<secret>") -> Column:
    """The text with every span, overlapping ones together, replaced by a mark."""
    t = f"`{text}`"
    step = f"if(x.start < s.at, named_struct('at', greatest(s.at, x.end), 'out', s.out), named_struct('at', x.end, 'out', concat(s.out, substring({t}, s.at + 1, x.start - s.at), '{mark}')))"
    return F.expr(f"if(size({spans}) = 0, {t}, aggregate({spans}, named_struct('at', 0, 'out', ''), (s, x) -> {step}, s -> concat(s.out, substring({t}, s.at + 1))))")


def scan(docs: DataFrame, text: str = "text", rows: DataFrame | None = None) -> DataFrame:
    """Add ``base`` and ``spans`` to every document; ``rows`` are own training rows (sample, random)."""
    if clash := {"base", "spans"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten: rename them first")
    based = base_spans(docs.withColumn(text, text_of(docs, text)), text)
    model = train(rows if rows is not None else samples(based, text))
    return all_spans(based, model, text)


def op10_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs)
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
