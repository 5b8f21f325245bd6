"""SQL functions of the dialect that Spark lacks, as session-temporary SQL functions (no Python but for JSON editing)."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

# JVM-side definitions; Catalyst inlines them
DEFINITIONS = (
    "text_extract(s STRING, i INT) RETURNS STRING RETURN coalesce(try_element_at(split(s, ' ', i + 2), i + 1), '')",
    """millrace_substr(s STRING, p INT, n INT) RETURNS STRING RETURN CASE
        WHEN n IS NULL THEN CASE WHEN p > 0 THEN substring(s, p) WHEN p = 0 THEN s ELSE substring(s, greatest(length(s) + p, 0) + 1) END
        WHEN n < 0 THEN substring(s, greatest((CASE WHEN p < 0 THEN length(s) + p + 1 ELSE p END) + n, 1), greatest(least(-n, (CASE WHEN p < 0 THEN length(s) + p + 1 ELSE p END) - 1), 0))
        WHEN p > 0 THEN substring(s, p, n)
        WHEN p = 0 THEN substring(s, 1, greatest(n - 1, 0))
        ELSE substring(s, greatest(length(s) + p, 0) + 1, greatest(n + least(length(s) + p, 0), 0)) END""",
    """millrace_glob(p STRING) RETURNS STRING RETURN concat('(?s)^', replace(replace(regexp_replace(p, '([.+^$(){}|\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')""",
    "millrace_typeof(t STRING) RETURNS STRING RETURN CASE WHEN t IN ('tinyint', 'smallint', 'int', 'bigint', 'boolean') THEN 'integer' WHEN t IN ('float', 'double') OR t LIKE 'decimal%' THEN 'real' WHEN t = 'binary' THEN 'blob' WHEN t = 'void' THEN 'null' ELSE 'text' END",
    "millrace_json_name(s STRING) RETURNS STRING RETURN regexp_extract(to_json(array(s)), '(?s)^\\\\[(.*)\\\\]$', 1)",
    """millrace_json_type(j STRING) RETURNS STRING RETURN CASE upper(split_part(schema_of_variant(try_parse_json(j)), '<', 1))
        WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BIGINT' THEN 'integer' WHEN 'STRING' THEN 'text' WHEN 'VOID' THEN 'null'
        WHEN 'BOOLEAN' THEN CASE WHEN trim(j) = 'true' THEN 'true' ELSE 'false' END WHEN 'DOUBLE' THEN 'real' ELSE CASE WHEN schema_of_variant(try_parse_json(j)) LIKE 'DECIMAL%' THEN 'real' END END""",
    """millrace_json_each(j STRING, p STRING) RETURNS TABLE (key STRING, value STRING, type STRING, atom STRING, id BIGINT, parent BIGINT, fullkey STRING, path STRING, json STRING)
        RETURN SELECT coalesce(e.key, cast(e.pos as string)), v, t, CASE WHEN t IN ('object', 'array') THEN NULL ELSE v END, cast(e.pos as bigint), cast(NULL as bigint),
            concat(coalesce(p, '$'), CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END), coalesce(p, '$'), j
        FROM (SELECT pos, key, CASE WHEN schema_of_variant(value) = 'STRING' THEN cast(value as string) WHEN schema_of_variant(value) = 'VOID' THEN NULL ELSE to_json(value) END AS v, millrace_json_type(to_json(value)) AS t
              FROM variant_explode_outer(CASE WHEN p IS NULL THEN try_parse_json(j) ELSE try_parse_json(get_json_object(j, p)) END) WHERE pos IS NOT NULL) e""",
)


def _steps(path: str) -> list:
    import re

    return [int(i) if i else k for k, i in re.findall(r"\.\"?([^.\[\"]+)\"?|\[(\d+)\]", path)]


def _edit(how: str, text: str | None, paths: list[str], values: list[str]) -> str | None:
    """json_set, json_insert, json_replace, json_remove on one document."""
    if text is None:
        return None
    doc = json.loads(text)
    for k, path in enumerate(paths):
        steps = _steps(path)
        if not steps:
            doc = None if how == "remove" else json.loads(values[k]) if how != "insert" else doc
            continue
        at = doc
        for s in steps[:-1]:
            at = at[s] if (isinstance(at, dict) and s in at) or (isinstance(at, list) and isinstance(s, int) and s < len(at)) else None
        last = steps[-1]
        there = (isinstance(at, dict) and last in at) or (isinstance(at, list) and isinstance(last, int) and last < len(at))
        if how == "remove":
            if there:
                del at[last]
        elif there and how in ("set", "replace"):
            at[last] = json.loads(values[k])
        elif not there and how in ("set", "insert"):
            if isinstance(at, dict):
                at[last] = json.loads(values[k])
            elif isinstance(at, list):
                at.append(json.loads(values[k]))
    return json.dumps(doc, separators=(",", ":"), ensure_ascii=False)


def _merge(a, b):
    if not isinstance(b, dict):
        return b
    out = dict(a) if isinstance(a, dict) else {}
    for k, v in b.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merge(out.get(k), v)
    return out


def _tree(text: str | None, path: str | None):
    """Rows of json_tree: every node, parents first."""
    if text is None:
        return
    kinds = {dict: "object", list: "array", str: "text", int: "integer", float: "real", type(None): "null"}
    ids = iter(range(1 << 40))

    def walk(key, value, parent, full, within):
        me = next(ids)
        kind = ("true" if value else "false") if isinstance(value, bool) else kinds[type(value)]
        shown = json.dumps(value, separators=(",", ":"), ensure_ascii=False) if isinstance(value, (dict, list)) else None if value is None else str(value) if not isinstance(value, bool) else str(int(value))
        yield (None if key is None else str(key), shown, kind, None if isinstance(value, (dict, list)) else shown, me, parent, full, within, text)
        for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            yield from walk(k, v, me, f"{full}[{k}]" if isinstance(value, list) else f"{full}.{k}", full)

    node = json.loads(text)
    for s in _steps(path or "$"):
        node = node[s]
    yield from walk(None, node, None, path or "$", path or "$")


def register(spark: SparkSession) -> None:
    """Register everything, once for each session."""
    if getattr(spark, "_millrace_functions", False):
        return
    from pyspark.sql import functions as F
    from pyspark.sql.functions import udtf

    for d in DEFINITIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {d}")
    spark.udf.register("millrace_json_edit", F.udf(_edit, "string", useArrow=True))
    spark.udf.register("millrace_json_patch", F.udf(lambda a, b: None if a is None or b is None else json.dumps(_merge(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False), "string", useArrow=True))

    class Tree:
        def eval(self, text: str, path: str):
            yield from _tree(text, path)

    spark.udtf.register("millrace_json_tree", udtf(Tree, returnType="key string, value string, type string, atom string, id bigint, parent bigint, fullkey string, path string, json string"))
    spark._millrace_functions = True
