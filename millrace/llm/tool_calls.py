"""Tool-call linking for chat data.

Messages (conversation, turn, role, text) give calls and results:

* ``<tool_call>{"id", "name", "arguments", "after"?}</tool_call>`` in any text is a call;
* a message of role ``tool`` whose text is a JSON object with ``call_id`` and ``content`` is a result;
* any other ``user`` message is a call of ``reply`` with the text as its argument and the id
  ``<conversation>:<turn>``, which waits for the call of the same kind two turns before, and any
  other ``assistant`` message is the result of the call one turn before it.

Calls and results are hash-partitioned by conversation and id, texts moving once, and joined
there. Identical calls and identical results are one row each, with their counts; different ones
that repeat an id in a conversation are all returned, the n-th call in order of turns with the
n-th result. Calls are put in topological order by the call each waits for (of repeats the n-th,
or the last where there are fewer): ``depth`` is the number of calls before it in its chain, by
pointer doubling over ids alone, so a chain of d calls takes log2(d) rounds. Arguments are
validated against the function's JSON schema, and call and result are serialised as canonical
JSON (sorted keys, no spaces, shortest numbers, UTF-8; a lone surrogate stays an escape).

Status: ``linked``, ``no_result``, ``no_call``. Edge cases: null text is the empty text, a null
conversation or turn gives a null id, and rows without a conversation or id are returned unlinked;
a call that waits for an absent call has depth 0; calls on a cycle have a null depth. A call that
is not JSON (NaN and infinities are not), no object, nested too deeply, or whose number has too
many digits for the JSON reader, is invalid with its text as name and the reason as error; so is,
under its own name and arguments, one whose name is no string or whose id is neither string nor
number (a number is its canonical text). A result that cannot be read has no id, and its text as
content. Repeated rows are counted; long texts are read whole; columns other than the four named
are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, lean, n_partitions, table, written
from .encoder import slices

CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
#: JSON schemas of functions by name.
SCHEMAS = {
    "reply": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
        "required": ["text", "turn"],
        "additionalProperties": False,
    }
}
PARTS = "kind string, id string, conv_id long, turn long, name string, arguments string, after string, content string, bad string, c long, h1 long, h2 long"
#: The order of different calls (or results) of one conversation and id.
ORDER = ["turn", "h1", "h2"]
SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _utf8(s: str) -> str:
    """The string, lone surrogates as escapes: what UTF-8 can hold."""
    return SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    """Canonical JSON: keys sorted by UTF-16 units, no spaces, integral numbers without a fraction."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(_utf8(json.dumps(k, ensure_ascii=False)) + ":" + canonical(value[k]) for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        if not math.isfinite(value):
            return "null"
        return str(int(value)) if value.is_integer() and abs(value) < 1e21 else repr(value)
    return _utf8(json.dumps(value, ensure_ascii=False))


def _no_constant(name: str):
    raise ValueError(name)


def _loads(text: str):
    return json.loads(text, parse_constant=_no_constant)


def _id(value) -> str | None:
    """An id: a string, or a number as its canonical text."""
    if isinstance(value, str):
        return _utf8(value)
    return canonical(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def problem(value, schema: dict, at: str = "$") -> str | None:
    """The first violation of a schema, or None. Keywords: type, enum, const, properties, required, additionalProperties, items, and bounds."""
    kinds = schema.get("type")
    if kinds is not None:
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        whole = number and (isinstance(value, int) or value.is_integer())
        if not any((k == "number" and number) or (k == "integer" and whole) or (k in TYPES and isinstance(value, TYPES[k])) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            return f"{at}: type"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: enum"
    if "const" in schema and value != schema["const"]:
        return f"{at}: const"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{at}: length"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{at}: range"
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
            return f"{at}: items"
        for i, x in enumerate(value):
            if p := problem(x, schema.get("items", {}), f"{at}[{i}]"):
                return p
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{at}.{k}: required"
        for k in sorted(value):
            if k in own:
                if p := problem(value[k], own[k], f"{at}.{k}"):
                    return p
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: additional"
    return None


def _call(raw: str, conv: int | None, turn: int | None) -> tuple:
    try:
        c = _loads(raw)
        arguments = canonical(c.get("arguments", {}))
    except RecursionError:
        return ("call", None, conv, turn, raw, None, None, None, "$: nested too deeply")
    except ValueError:
        return ("call", None, conv, turn, raw, None, None, None, "$: not JSON")
    except AttributeError:
        return ("call", None, conv, turn, raw, None, None, None, "$: no object")
    name, own, after = c.get("name"), c.get("id"), c.get("after")
    bad = "$.name: type" if not isinstance(name, str) else "$.id: type" if own is not None and _id(own) is None else "$.after: type" if after is not None and _id(after) is None else None
    return ("call", _id(own), conv, turn, _utf8(name) if isinstance(name, str) else None, arguments, _id(after), None, bad)


def _parts(conv: int | None, turn: int | None, role: str | None, text: str | None) -> list[tuple]:
    """kind, id, conversation, turn, name, arguments, after, content, reason why it is invalid."""
    text = text or ""
    named = conv is not None and turn is not None
    out = [_call(raw, conv, turn) for raw in CALL.findall(text)]
    if role == "tool":
        try:
            r = _loads(text)
            out.append(("result", _id(r["call_id"]), conv, turn, None, None, None, canonical(r.get("content")), None))
        except (ValueError, KeyError, TypeError, AttributeError, RecursionError):
            out.append(("result", None, conv, turn, None, None, None, canonical(text), None))
    elif role == "user" and not out:
        out.append(("call", f"{conv}:{turn}" if named else None, conv, turn, "reply", canonical({"text": text, "turn": turn}), f"{conv}:{turn - 2}" if named else None, None, None))
    elif role == "assistant" and not out:
        out.append(("result", f"{conv}:{turn - 1}" if named else None, conv, turn, None, None, None, canonical(text), None))
    return out


def extract(messages: DataFrame) -> DataFrame:
    """Calls and results of the messages, one row for all identical ones of a batch: ``c`` of them, h1 and h2 the hash of what they say."""

    def parts(batches):
        for batch in batches:
            for b in slices(batch, 3):
                rows = Counter(p for m in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for p in _parts(*m))
                columns = list(zip(*rows, strict=True)) or [()] * 9
                digests = [xxhash.xxh3_128_digest(repr((p[0], *p[4:])).encode()) for p in rows]
                halves = [pa.array([int.from_bytes(d[i : i + 8], "little", signed=True) for d in digests], pa.int64()) for i in (0, 8)]
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), pa.array(list(rows.values()), pa.int64()), *halves], [c.split()[0] for c in PARTS.split(", ")])

    m = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return m.mapInArrow(lean(parts), PARTS)


def depths(calls: DataFrame) -> DataFrame:
    """id, depth of calls (id, after), ids distinct, by pointer doubling; null on or behind a cycle."""
    first = calls.select("id", "after").join(calls.select(F.col("id").alias("after"), F.lit(True).alias("there")), "after", "left")
    at = written(first.select("id", F.when(F.col("there"), F.col("after")).alias("next"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth")), "chains")
    rounds, n = 0, at.count()
    while at.where("next is not null").limit(1).count():
        if 1 << rounds > n:
            break
        step = at.select(F.col("id").alias("next"), F.col("next").alias("then"), F.col("depth").alias("more"))
        new = written(at.join(step, "next", "left").select("id", F.col("then").alias("next"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "chains")
        discard(at)
        at, rounds = new, rounds + 1
    return at.select("id", F.when(F.col("next").isNull(), F.col("depth")).alias("depth"))


def _depths_of(named: DataFrame) -> DataFrame:
    """conv_id, id, nth, depth of every distinct call; no text is read."""
    calls = named.where("kind = 'call'").select("conv_id", "id", *ORDER, "after").distinct()
    calls = written(calls.withColumn("nth", F.row_number().over(W.partitionBy("conv_id", "id").orderBy(*ORDER))), "calls")
    # chains run over texts that name a call: conversation, place among repeats, id
    most = calls.groupBy("conv_id", F.col("id").alias("after")).agg(F.max("nth").alias("most"))
    node = lambda nth, i: F.concat_ws(":", "conv_id", nth, i)
    chain = calls.join(most, ["conv_id", "after"], "left").select(node("nth", "id").alias("id"), F.when(F.col("most").isNotNull(), node(F.least("nth", "most"), "after")).alias("after"))
    found = calls.select("conv_id", "id", "nth", node("nth", "id").alias("node")).join(depths(chain).withColumnRenamed("id", "node"), "node").drop("node")
    return found


def link(parts: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """id, conv_id, turn, name, status, depth, n_calls, n_results, valid, error, json of every distinct call with its result, and of results without a call."""
    parts = written(parts, "parts")
    named, key = parts.where("id is not null and conv_id is not null"), ["conv_id", "id"]
    # rows that tell a call's depth travel with its text, so that texts move once
    deep = _depths_of(named).select(F.lit("depth").alias("kind"), *key, "nth", "depth")
    met = named.withColumns({"nth": F.lit(None).cast("int"), "depth": F.lit(None).cast("long")}).unionByName(deep, allowMissingColumns=True)
    met = met.repartition(n_partitions(parts.sparkSession), *key)
    # what follows keeps that partitioning: identical rows as one, their places, calls and results of one place together
    texts = ["name", "arguments", "content", "bad"]
    once = met.groupBy(*key, "kind", *ORDER, "nth", "depth").agg(*[F.first(c).alias(c) for c in texts], F.sum("c").alias("c"))
    place = F.row_number().over(W.partitionBy(*key, "kind").orderBy(*ORDER, "nth"))
    placed = once.withColumn("nth", F.when(F.col("kind") == "depth", F.col("nth")).otherwise(place))

    def of(kind, name, c=None):
        return F.first(F.when(F.col("kind") == kind, F.col(c or name)), ignorenulls=True).alias(name)

    both = placed.groupBy(*key, "nth").agg(
        of("call", "called", "turn"), of("result", "answered", "turn"), *[of("call", c) for c in ("name", "arguments", "bad")], of("result", "content"), of("depth", "depth"), of("call", "n_calls", "c"), of("result", "n_results", "c")
    )
    columns = ["name", "arguments", "content", "bad", "depth"]
    rows = both.select("id", "conv_id", F.coalesce("called", "answered").alias("turn"), *columns, F.coalesce("n_calls", F.lit(0)).alias("n_calls"), F.coalesce("n_results", F.lit(0)).alias("n_results"))
    lone = parts.where("id is null or conv_id is null").groupBy("id", "conv_id", "turn", "kind", "name", "arguments", "content", "bad").agg(F.sum("c").alias("c"))
    lone = lone.withColumn("depth", F.lit(None).cast("long")).select("id", "conv_id", "turn", *columns, *[F.when(F.col("kind") == k, F.col("c")).otherwise(0).alias(n) for k, n in (("call", "n_calls"), ("result", "n_results"))])
    known = dict(SCHEMAS if schemas is None else schemas)

    def finish(batches):
        for batch in batches:
            for b in slices(batch, 4):
                out = [[], [], [], []]
                for i, name, arguments, content, bad, n, m in zip(*(b.column(k).to_pylist() for k in ("id", "name", "arguments", "content", "bad", "n_calls", "n_results")), strict=True):
                    error, fields = bad, []
                    if n:
                        if error is None:
                            error = "unknown function" if name not in known else problem(json.loads(arguments), known[name])
                            error = error and _utf8(error)
                        fields = ['"arguments":' + (arguments or "null"), '"id":' + canonical(i), '"name":' + canonical(name)]
                    if m:
                        fields = [*(fields or ['"id":' + canonical(i)]), '"result":' + content]
                    for column, value in zip(out, ("linked" if n and m else "no_result" if n else "no_call", None if not n else error is None, error, "{" + ",".join(fields) + "}"), strict=True):
                        column.append(value)
                keep = [b.column(k) for k in ("id", "conv_id", "turn", "name", "depth", "n_calls", "n_results")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(out[0], pa.string()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], ["id", "conv_id", "turn", "name", "depth", "n_calls", "n_results", "status", "valid", "error", "json"])

    return rows.unionByName(lone).mapInArrow(lean(finish), "id string, conv_id long, turn long, name string, depth long, n_calls long, n_results long, status string, valid boolean, error string, json string")


def ordered(linked: DataFrame) -> DataFrame:
    """Linked rows in topological order within their conversation; calls on cycles last."""
    return linked.orderBy("conv_id", F.col("depth").asc_nulls_last(), "turn", "id")


def op8_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(extract(table(spark, sf_dir, "conversations")))
