"""The registered queries: one for each operator, by key, with its DuckDB SQL.

A query is either SQL that goes through the engine's own front end (``_sql``) or a plan built with
the frame and expression API (``_api``). Integer results are BIGINT on both sides and sums of
doubles are rounded, so that values compare exactly.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import BoolExpr, DatetimeExpr, DoubleExpr, IntExpr, StringExpr
from ..operators.frame import CROSS_JOIN, EQUI_JOIN, LEFT_JOIN, OUTER_JOIN, RIGHT_JOIN, Frame, Series
from ..session import configure, shared_dir
from ..sources.files import packed
from ..sources.registry import read_sources, write_source
from ..streaming.events import sessions, windowed
from .engine import register_function, run_sql

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> Frame:
    return Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


def _sql(key: str, text: str, oracle: str | None = None, compat: str | None = None) -> None:
    """A query in the engine's dialect; the oracle is the same text unless DuckDB spells it differently."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        configure(spark)
        return run_sql(spark, text, {t: frame(spark, sf_dir, t).df for t in TABLES if t in text}, compat=compat)

    _QUERIES[key] = query
    _ORACLE[key] = oracle or text


def _api(key: str, oracle: str | None):
    def register(f: Callable) -> Callable:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            out = f(lambda name: frame(spark, sf_dir, name))
            return out.df if isinstance(out, Frame) else out

        _QUERIES[key] = query
        if oracle:
            _ORACLE[key] = oracle
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


# ---------------------------------------------------------------- scans and projections
_sql("pricing_summary", """
SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_discount), 6) AS disc
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")  # fmt: skip
_sql("scan_project", "SELECT n_name, n_regionkey FROM nation")
_sql("project_expr", "SELECT p_partkey, p_retailprice * 2 AS double_price, p_size + 1 AS next_size, p_name || '!' AS loud FROM part")
_sql("select_without_from", "SELECT 1 + 1 AS two, 'a' || 'b' AS ab")
_api("select_by_index", "SELECT n_name, n_nationkey FROM nation")(lambda t: t("nation").select_by_index(1, 0))
_api("select_by_name", "SELECT n_regionkey, n_name FROM nation")(lambda t: t("nation").select_by_name("N_REGIONKEY", "n_name"))
_api("select_typed_exprs", "SELECT upper(n_name) AS up, n_nationkey * 10 AS ten FROM nation WHERE n_name LIKE '%A%'")(
    lambda t: t("nation").as_format({"n_nationkey": "integer"}).select(StringExpr.col("n_name").contains("A").upper().alias("up"), IntExpr.col("n_nationkey").op_const("*", 10).alias("ten")).as_format({"ten": "integer"}).select(F.col("up"), F.col("ten").cast("int").alias("ten"))
)
_api("rename_drop", "SELECT n_nationkey AS id, n_regionkey FROM nation")(lambda t: t("nation").rename_series("n_nationkey", "id").remove_series("n_name"))
_api("add_update_series", "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey, lower(n_name) AS low FROM nation")(
    lambda t: t("nation").add_series("low", F.lower("n_name")).update_series("n_nationkey", F.col("n_nationkey") + 1)
)
_api("add_series_positional", "SELECT r_regionkey, r_name, upper(r_name) AS up FROM region")(lambda t: t("region").add_series("up", t("region").get_series("r_name").select(StringExpr.root().upper())))
_api("cast_formats", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, epoch_ms(o_orderdate) AS o_orderdate FROM orders")(
    lambda t: t("orders").select_by_name("o_orderkey", "o_totalprice", "o_orderdate").as_format({"o_orderkey": "string", "o_totalprice": "integer", "o_orderdate": "integer"})
)
_api("cast_string_to_numbers", "SELECT CAST(p_size AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS d, p_size <> 0 AS b FROM part")(
    lambda t: (lambda f: f._new(f.df.select(F.col("s"), F.col("s").alias("i"), F.col("s").alias("d"), F.col("n").alias("b"))).as_format({"i": "integer", "d": "double", "b": "boolean"}).remove_series("s"))(
        t("part").select(F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("s"), F.col("p_size").cast("long").alias("n"))
    )
)
_api("map_row", "SELECT n_nationkey * 2 AS k, n_name || '#' AS s FROM nation")(lambda t: t("nation").map_row("k int, s string", lambda r: (r["n_nationkey"] * 2, r["n_name"] + "#")))
_api("flat_map_row", "SELECT n_name, CAST(i AS INT) AS i FROM nation, (VALUES (0), (1), (2)) v(i) WHERE i < n_regionkey")(
    lambda t: t("nation").flat_map_row("n_name string, i int", lambda r: [(r["n_name"], i) for i in range(min(3, r["n_regionkey"]))])
)
_api("series_flat_map", "SELECT w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part)")(lambda t: t("part").get_series("p_name").flat_map("string", lambda v: v.split(" ")).df.toDF("w"))
_api("fill_null", "SELECT c.c_custkey, coalesce(o.o_orderstatus, 'none') AS o_orderstatus, coalesce(o.o_totalprice, 0.0) AS o_totalprice FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")(
    lambda t: t("customer").join(t("orders"), LEFT_JOIN, {"c_custkey": "o_custkey"}).when_nil({"o_orderstatus": "none", "o_totalprice": 0.0}).select_by_name("c_custkey", "o_orderstatus", "o_totalprice")
)
_api("value_map", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")(
    lambda t: t("orders").select_by_name("o_orderkey", "o_orderstatus").when({"o_orderstatus": {"F": "done", "O": "open"}})
)
_api("const_series", "SELECT n_name, 7 AS seven FROM nation")(lambda t: t("nation").select_by_name("n_name").add_series("seven", F.lit(7)))
_api("range_series", "SELECT range AS value FROM range(5, 100, 3)")(lambda t: Series.range(t("nation").df.sparkSession, 100, 5, 3).df)
_api("row_is_any_nil", "SELECT c.c_custkey, (c.c_name IS NULL OR o.o_orderkey IS NULL) AS any_nil FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")(
    lambda t: t("customer").join(t("orders"), LEFT_JOIN, {"c_custkey": "o_custkey"}).df.select("c_custkey", (F.col("c_name").isNull() | F.col("o_orderkey").isNull()).alias("any_nil"))
)

# ---------------------------------------------------------------- filters
_sql("filter_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount <= 0.05 AND l_tax <> 0.02 AND l_linenumber >= 2 AND l_shipdate < TIMESTAMP '1996-01-01'", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount <= 0.05::DOUBLE AND l_tax <> 0.02::DOUBLE AND l_linenumber >= 2 AND l_shipdate < TIMESTAMP '1996-01-01'")
_sql("filter_double_equals", "SELECT o_orderkey FROM orders WHERE o_orderstatus == 'F'", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
for _inc, _low, _high in (("left", ">=", "<"), ("right", ">", "<="), ("both", ">=", "<="), ("neither", ">", "<")):
    _api(f"filter_between_{_inc}", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber {_low} 2 AND l_linenumber {_high} 5 AND l_quantity {_low} 10 AND l_quantity {_high} 30")(
        lambda t, inc=_inc: t("lineitem").where_row(IntExpr.col("l_linenumber").between(2, 5, inc)).where_row(DoubleExpr.col("l_quantity").between(10.0, 30.0, inc)).select_by_name("l_orderkey", "l_linenumber")
    )
_api("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 7 IN (1, 2)")(
    lambda t: t("orders").where_row(StringExpr.col("o_orderpriority").in_const("1-URGENT", "2-HIGH")).where_row((F.col("o_orderkey") % 7).isin(1, 2)).select_by_name("o_orderkey")
)
_api("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")(lambda t: t("orders").where_row(StringExpr.col("o_orderpriority").not_in_const("1-URGENT", "2-HIGH")).select_by_name("o_orderkey"))
_NULLS = "(SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, nullif(o_orderkey % 5, 0) AS m, nullif(o_orderkey % 3, 0) AS k FROM orders)"
_nulls = lambda t: Frame(t("orders").df.select("o_orderkey", F.expr("nullif(o_orderstatus, 'F')").alias("s"), F.expr("nullif(o_orderkey % 5, 0)").alias("m"), F.expr("nullif(o_orderkey % 3, 0)").alias("k")))
_api("filter_null_safe_eq", f"SELECT o_orderkey FROM {_NULLS} WHERE m IS NOT DISTINCT FROM k")(lambda t: _nulls(t).where_row(IntExpr.col("m").eq(IntExpr.col("k"))).select_by_name("o_orderkey"))
_api("filter_null_safe_ne", f"SELECT o_orderkey FROM {_NULLS} WHERE m IS DISTINCT FROM 3")(lambda t: _nulls(t).where_row(IntExpr.col("m").ne(3)).select_by_name("o_orderkey"))
_api("filter_string_ne_null", f"SELECT o_orderkey FROM {_NULLS} WHERE s <> 'O'")(lambda t: _nulls(t).where_row(StringExpr.col("s").ne("O")).select_by_name("o_orderkey"))
_api("filter_non_nil", f"SELECT o_orderkey FROM {_NULLS} WHERE s IS NOT NULL AND m IS NOT NULL")(lambda t: _nulls(t).where_row(StringExpr.col("s").non_nil()).where_row(IntExpr.col("m").non_nil()).select_by_name("o_orderkey"))
_api("filter_bool_logic", f"SELECT o_orderkey, (p IS NOT NULL AND q IS NOT NULL AND p AND q) AS a, (p IS NOT NULL AND q IS NOT NULL AND (p OR q)) AS o, coalesce(NOT p, false) AS n FROM (SELECT o_orderkey, m > 2 AS p, k > 1 AS q FROM {_NULLS})")(
    lambda t: Frame(_nulls(t).df.select("o_orderkey", (F.col("m") > 2).alias("p"), (F.col("k") > 1).alias("q"))).select("o_orderkey", BoolExpr.col("p").and_(BoolExpr.col("q")).alias("a"), BoolExpr.col("p").or_(BoolExpr.col("q")).alias("o"), BoolExpr.col("p").not_().alias("n"))
)
_api("filter_datetime_cmp", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")(
    lambda t: t("orders").where_row(DatetimeExpr.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-01-01").cast("timestamp_ntz"), "left")).select_by_name("o_orderkey")
)
_api("filter_chain", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 IN (1, 2, 3) AND o_orderkey % 10 = 2")(
    lambda t: t("orders").add_series("d", F.col("o_orderkey") % 10).where_row(IntExpr.col("d").in_const(1, 2, 3).eq_const(2)).select_by_name("o_orderkey")
)
_sql("filter_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE 'S%' AND p_brand LIKE 'Brand_1_'")
_sql("filter_like_nocase", "SELECT p_partkey FROM part WHERE p_type LIKE 'std%' OR p_type LIKE '%a%'", "SELECT p_partkey FROM part WHERE p_type ILIKE 'std%' OR p_type ILIKE '%a%'", compat="sqlite")
_sql("filter_glob", "SELECT p_partkey FROM part WHERE p_name GLOB '*[aeiou]?*' AND p_brand GLOB 'Brand#[1-3]*'")
_sql("filter_regexp", "SELECT doc_id FROM documents WHERE text REGEXP '[0-9]{3}' AND regexp('a[nt]', lang || text)", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{3}') AND regexp_matches(lang || text, 'a[nt]')")
_sql("filter_match", "SELECT page_id FROM pages WHERE html MATCH 'div' AND match('/', url) AND NOT html MATCH 'zzzz'", "SELECT page_id FROM pages WHERE contains(html, 'div') AND contains(url, '/') AND NOT contains(html, 'zzzz')")
_api("filter_starts_ends", "SELECT p_partkey FROM part WHERE starts_with(p_type, 'S') OR ends_with(p_brand, '3') OR contains(p_name, 'q')")(
    lambda t: t("part").where_row(StringExpr.col("p_type").starts_with("S").predicate() | StringExpr.col("p_brand").ends_with("3").predicate() | StringExpr.col("p_name").contains("q").predicate()).select_by_name("p_partkey")
)
_sql("filter_is_operators", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS 'F' AND o_orderpriority IS NOT '5-LOW' AND o_custkey NOTNULL", "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT DISTINCT FROM 'F' AND o_orderpriority IS DISTINCT FROM '5-LOW' AND o_custkey IS NOT NULL")
_api("filter_closure", "SELECT n_name FROM nation WHERE length(n_name) % 2 = 0")(lambda t: t("nation").where_row(lambda r: len(r["n_name"]) % 2 == 0).select_by_name("n_name"))

# ---------------------------------------------------------------- joins
_sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'")
_sql("join_right", "SELECT c_name, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 200000")
# a shifted key leaves rows of both whole tables without a partner
_sql("join_full", "SELECT s_suppkey, c_custkey FROM supplier s FULL OUTER JOIN customer c ON s_suppkey = c_custkey + 5")
_sql("join_cross", "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r")
_sql("join_comma_count", "SELECT CAST(COUNT(*) AS BIGINT) AS n FROM nation, region, supplier")
_sql("join_natural", "SELECT a.r_regionkey, r_name FROM region a NATURAL JOIN (SELECT r_regionkey FROM region WHERE r_regionkey > 1) b", "SELECT r_regionkey, r_name FROM region a NATURAL JOIN (SELECT r_regionkey FROM region WHERE r_regionkey > 1) b")
_sql("join_using", "SELECT r_regionkey, a.r_name AS x, b.r_name AS y FROM region a JOIN region b USING (r_regionkey)")
_sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_range", "SELECT p.p_partkey, r.r_regionkey FROM part p JOIN region r ON p.p_size BETWEEN r.r_regionkey * 10 AND r.r_regionkey * 10 + 9")
_sql("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")
_api("join_equi_map", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")(lambda t: t("nation").join(t("region"), EQUI_JOIN, {"n_regionkey": "r_regionkey"}).remove_series("r_regionkey"))
# null keys meet; one side is one row a key, so that the join of the whole tables stays as small as the other
_api("join_null_keys_match", f"SELECT a.o_orderkey AS x, b.y, b.n FROM {_NULLS} a JOIN (SELECT m, MIN(o_orderkey) AS y, CAST(COUNT(*) AS BIGINT) AS n FROM {_NULLS} GROUP BY m) b ON a.m IS NOT DISTINCT FROM b.m")(
    lambda t: Frame(_nulls(t).df.select(F.col("o_orderkey").alias("x"), F.col("m").alias("mx")))
    .join(Frame(_nulls(t).df.groupBy(F.col("m").alias("my")).agg(F.min("o_orderkey").alias("y"), F.count(F.lit(1)).alias("n"))), EQUI_JOIN, {"mx": "my"})
    .select_by_name("x", "y", "n")
)
for _how, _sqlhow in ((LEFT_JOIN, "LEFT"), (RIGHT_JOIN, "RIGHT"), (OUTER_JOIN, "FULL")):
    _api(f"join_api_{_how}", f"SELECT s.s_suppkey, c.k FROM supplier s {_sqlhow} JOIN (SELECT c_custkey + 5 AS k FROM customer) c ON s_suppkey = k")(
        lambda t, how=_how: t("supplier").join(t("customer").select(IntExpr.col("c_custkey").op_const("+", 5).alias("k")), how, {"s_suppkey": "k"}).select_by_name("s_suppkey", "k")
    )
_api("join_api_cross", "SELECT n_name, r_name FROM nation, region")(lambda t: t("nation").join(t("region"), CROSS_JOIN).select_by_name("n_name", "r_name"))
_api("join_positional", "SELECT a.n_name, b.n_name AS n_name_right FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) a JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS i FROM nation) b ON a.i = b.i")(
    lambda t: t("nation").sort("n_nationkey").select_by_name("n_name").join(t("nation").sort(("n_nationkey", False)).select_by_name("n_name"), EQUI_JOIN, by_position=True)
)
_sql("semi_join", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
_sql("anti_join", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
_sql("join_five_tables", "SELECT r_name, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_sql("lateral_json_each", "SELECT event_id, json_each.key, json_each.value FROM events, json_each(events.props)", "SELECT event_id, key, CAST(props::JSON -> key AS VARCHAR) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
_sql("json_extract", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props ->> '$.k' AS t FROM events", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, props ->> '$.k' AS t FROM events")
_sql("json_array_length", "SELECT json_array_length('[1,2,3]') AS n, json_valid('{\"a\":1}') AS ok, json_valid('{a') AS bad, json_type('{\"a\":1}') AS t", "SELECT 3 AS n, 1 AS ok, 0 AS bad, 'object' AS t")
_sql("json_build", "SELECT n_nationkey, json_object('id', n_nationkey, 'name', n_name) AS o, json_array(n_nationkey, n_name, NULL) AS a, json_quote(n_name) AS q FROM nation", "SELECT n_nationkey, '{\"id\":' || n_nationkey || ',\"name\":\"' || n_name || '\"}' AS o, '[' || n_nationkey || ',\"' || n_name || '\",null]' AS a, '\"' || n_name || '\"' AS q FROM nation")
_sql("json_editors", """SELECT n_nationkey, json_set('{"a":1}', '$.b', n_nationkey) AS s, json_insert('{"a":1}', '$.a', 5) AS i, json_replace('{"a":1}', '$.a', n_name) AS r, json_remove('{"a":1,"b":2}', '$.a') AS d, json_patch('{"a":1,"b":2}', '{"a":null}') AS p FROM nation""",
     """SELECT n_nationkey, '{"a":1,"b":' || n_nationkey || '}' AS s, '{"a":1}' AS i, '{"a":"' || n_name || '"}' AS r, '{"b":2}' AS d, '{"b":2}' AS p FROM nation""")  # fmt: skip
_sql("json_groups", "SELECT n_nationkey, json_group_array(n_name) AS a, json_group_object(n_name, n_nationkey) AS o FROM nation GROUP BY n_nationkey", "SELECT n_nationkey, '[\"' || n_name || '\"]' AS a, '{\"' || n_name || '\":' || n_nationkey || '}' AS o FROM nation")
_sql("lateral_json_tree", "SELECT event_id, CAST(COUNT(*) AS BIGINT) AS n FROM events, json_tree(events.props) GROUP BY event_id", "SELECT event_id, CAST(1 + len(json_keys(props)) AS BIGINT) AS n FROM events")

# ---------------------------------------------------------------- aggregation
_sql("group_sum_min_max_mean", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS s, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(AVG(l_quantity), 6) AS m, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
_api("expr_aggregates", "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_custkey) AS lo, MAX(o_custkey) AS hi, ROUND(AVG(o_custkey), 6) AS m FROM orders GROUP BY o_orderstatus")(
    lambda t: t("orders").group("o_orderstatus").agg(*[getattr(IntExpr.col("o_custkey"), f)().alias(a) for f, a in (("agg_sum", "s"), ("agg_min", "lo"), ("agg_max", "hi"))], F.round(IntExpr.col("o_custkey").agg_mean().aggregate(), 6).alias("m"))
)
_sql("median", "SELECT o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
_api("value_counts", "SELECT event_type AS value, CAST(COUNT(*) AS BIGINT) AS count FROM events GROUP BY event_type")(lambda t: t("events").get_series("event_type").count_distinct_values().withColumnRenamed("event_type", "value"))
_sql("having", "SELECT o_custkey, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12")
_sql("distinct_sql", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_api("distinct_cols", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY ALL")(lambda t: t("orders").distinct("o_orderstatus", "o_orderpriority").select_by_name("o_orderstatus", "o_orderpriority"))
_api("distinct_series", "SELECT DISTINCT c_mktsegment FROM customer")(lambda t: t("customer").get_series("c_mktsegment").distinct().df)
_sql("count_distinct", "SELECT l_returnflag, CAST(COUNT(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
_sql("filter_agg", "SELECT o_orderstatus, CAST(COUNT(*) FILTER (WHERE o_totalprice > 100000) AS BIGINT) AS n, CAST(SUM(o_custkey) FILTER (WHERE o_custkey % 2 = 0) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus")
_sql("string_agg", "SELECT r_regionkey, length(group_concat(n_name)) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey", "SELECT r_regionkey, CAST(length(string_agg(n_name, ',')) AS INT) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
# the order within a group is free: the parts are compared in order
_sql("group_concat_separator", "SELECT n_regionkey, array_join(array_sort(split(group_concat(n_name, '|'), '[|]')), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_sql("total", "SELECT o_orderstatus, total(nullif(o_orderstatus, o_orderstatus)) AS z, ROUND(total(o_custkey), 2) AS t FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, 0.0::DOUBLE AS z, ROUND(SUM(o_custkey::DOUBLE), 2) AS t FROM orders GROUP BY o_orderstatus")
_api("group_where", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 15)")(lambda t: t("orders").group("o_custkey").where(F.count(F.lit(1)) >= 15).select_by_name("o_orderkey"))
_api("group_keys", "SELECT DISTINCT n_regionkey FROM nation")(lambda t: t("nation").group("n_regionkey").get_keys())
_api("group_get", "SELECT n_name FROM nation WHERE n_regionkey = 2")(lambda t: t("nation").group("n_regionkey").get(2).select_by_name("n_name"))


def _spread(key, pdf):
    import pandas as pd

    return pd.DataFrame({"n_regionkey": [key[0]], "spread": [int(pdf.n_nationkey.max() - pdf.n_nationkey.min())]})


_api("group_map", "SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS BIGINT) AS spread FROM nation GROUP BY n_regionkey")(lambda t: t("nation").group("n_regionkey").map(_spread, "n_regionkey int, spread long"))


@_api("reduce_fold", "SELECT CAST(SUM(l_linenumber * 3 + 1) AS BIGINT) AS s FROM lineitem")
def _reduced(t):
    series = t("lineitem").get_series("l_linenumber")
    total = series.reduce(lambda a, x: a + x * 3 + 1, F.lit(0).cast("long"), merge=lambda a, b: a + b)
    return series.df.sparkSession.range(1).select(F.lit(total).cast("long").alias("s"))


_sql("bare_columns", "SELECT n_regionkey, n_name AS last, max(n_nationkey) AS k FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS last, max(n_nationkey) AS k FROM nation GROUP BY n_regionkey")
_sql("bare_columns_any", "SELECT o.o_custkey, c_name, CAST(count(*) AS BIGINT) AS n FROM orders o JOIN customer ON c_custkey = o.o_custkey GROUP BY o.o_custkey", "SELECT o_custkey, min(c_name) AS c_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey")
_sql("rollup", "SELECT o_orderstatus, o_orderpriority, CAST(COUNT(*) AS BIGINT) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
_sql("cube", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(COUNT(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
# an estimate is right if it is close: the dialect's standard error is 1.6 %, six times that is allowed
_sql("approx_distinct", "SELECT l_returnflag, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS near FROM lineitem")

# ---------------------------------------------------------------- windows
_O = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"
for _name, _f in (("row_number", "row_number()"), ("rank", "rank()"), ("dense_rank", "dense_rank()"), ("ntile", "ntile(3)")):
    _sql(f"win_{_name}", f"SELECT o_orderkey, CAST({_f} {_O} AS BIGINT) AS w FROM orders")
for _name, _f in (("percent_rank", "percent_rank()"), ("cume_dist", "cume_dist()")):
    _sql(f"win_{_name}", f"SELECT o_orderkey, ROUND({_f} {_O}, 9) AS w FROM orders")
for _name, _f in (("lag", "lag(o_orderkey)"), ("lag_default", "lag(o_orderkey, 2, -1)"), ("lead", "lead(o_totalprice, 1)"), ("first_value", "first_value(o_orderkey)"), ("sum", "ROUND(sum(o_totalprice)")):
    _close = ", 2)" if _f.startswith("ROUND") else ""
    _sql(f"win_{_name}", f"SELECT o_orderkey, {_f} {_O}{_close} AS w FROM orders")
_FULL = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_sql("win_last_value", f"SELECT o_orderkey, last_value(o_orderkey) {_FULL} AS w FROM orders")
_sql("win_nth_value", f"SELECT o_orderkey, nth_value(o_orderkey, 2) {_FULL} AS w FROM orders")
_sql("win_aggregates", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS hi, min(o_totalprice) OVER (PARTITION BY o_custkey) AS lo FROM orders")
_sql("win_frame_rows", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS w FROM orders")
_sql("win_frame_range", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey RANGE BETWEEN 50 PRECEDING AND 50 FOLLOWING) AS BIGINT) AS w FROM orders")
_sql("win_named", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS r, CAST(sum(o_orderkey) OVER w AS BIGINT) AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_sql("win_filter", "SELECT o_orderkey, CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS w FROM orders", "SELECT o_orderkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS BIGINT) AS w FROM orders")


_sql("win_frame_groups", "SELECT o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS w FROM orders")
for _name, _f in (("current", "CAST(coalesce(sum(o_orderkey) {}, 0) AS BIGINT)"), ("current_min", "min(o_orderkey) {}"), ("current_avg", "ROUND(avg(o_totalprice) {}, 4)")):
    _call = _f.format("OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)")
    _sql(f"win_exclude_{_name}", f"SELECT o_orderkey, {_call} AS w FROM orders")


# ---------------------------------------------------------------- order, limits, sets
_api("sort_multi", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")(lambda t: t("orders").sort(("o_orderstatus", False), "o_totalprice", "o_orderkey").select_by_name("o_orderkey", "o_custkey"))
_sql("sort_nulls_limit", f"SELECT o_orderkey, m FROM {_NULLS} n ORDER BY m, o_orderkey LIMIT 40", f"SELECT o_orderkey, m FROM {_NULLS} n ORDER BY m NULLS FIRST, o_orderkey LIMIT 40")
_sql("sort_collate_nocase", "SELECT p_partkey FROM part ORDER BY p_name COLLATE NOCASE, p_partkey", "SELECT p_partkey FROM part ORDER BY lower(p_name), p_partkey")
_sql("limit_offset", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 20 OFFSET 100")
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_api("series_sort_limit", "SELECT c_name FROM customer ORDER BY c_name LIMIT 10 OFFSET 5")(lambda t: t("customer").get_series("c_name").sort().limit(5, 10).df)
_sql("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
_sql("union", "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
_sql("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0")
_sql("except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
_sql("set_chain_left_assoc", "SELECT 1 AS k UNION SELECT 2 AS k INTERSECT SELECT 2 AS k", "(SELECT 1 AS k UNION SELECT 2 AS k) INTERSECT SELECT 2 AS k")
_api("append", "SELECT * FROM nation UNION ALL SELECT * FROM nation")(lambda t: t("nation").append(t("nation")))
_api("frame_intersection", "SELECT n_nationkey FROM nation INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 9")(lambda t: t("nation").select_by_name("n_nationkey").intersection(t("nation").where_row(F.col("n_nationkey") < 9).select_by_name("n_nationkey")))
_api("frame_except", "SELECT n_nationkey FROM nation EXCEPT SELECT n_nationkey FROM nation WHERE n_nationkey < 9")(lambda t: t("nation").select_by_name("n_nationkey").except_(t("nation").where_row(F.col("n_nationkey") < 9).select_by_name("n_nationkey")))
_api("series_set_ops", "SELECT n_nationkey AS n_regionkey FROM nation EXCEPT SELECT n_regionkey FROM nation")(lambda t: Frame(t("nation").df.select(F.col("n_nationkey").alias("n_regionkey"))).get_series(0).except_(t("nation").get_series("n_regionkey")).df)
_api("merge_frames", "SELECT r_regionkey AS k, r_name AS s FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")(lambda t: Frame.merge(Frame(t("region").df.toDF("k", "s")), t("nation").select_by_name("n_nationkey", "n_name")))

# ---------------------------------------------------------------- subqueries
_sql("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 1.5 FROM orders)")
_sql("correlated_subquery", "SELECT c_custkey, (SELECT CAST(COUNT(*) AS BIGINT) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_sql("in_subquery", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
_sql("exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_sql("not_exists", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
_sql("derived_table", "SELECT s, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT o_orderstatus AS s FROM orders WHERE o_custkey > 10) t GROUP BY s")
_sql("cte", "WITH big AS (SELECT o_custkey AS k, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey), named AS (SELECT c_name, total FROM big JOIN customer ON k = c_custkey) SELECT c_name, ROUND(total, 2) AS total FROM named WHERE total > 1000000")
_sql("recursive_cte", "WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT n, n * n AS sq FROM c")
_sql("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders")
_sql("values_rows", "VALUES (1, 'a'), (2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) v(col1, col2)")
_sql("pragma_table_info", "pragma table_info(\"nation\")", "SELECT * FROM (VALUES (0, 'n_nationkey', 'integer', 0, CAST(NULL AS VARCHAR), 0), (1, 'n_name', 'text', 0, NULL, 0), (2, 'n_regionkey', 'integer', 0, NULL, 0)) v(cid, name, type, \"notnull\", dflt_value, pk)")

# ---------------------------------------------------------------- strings
_str = lambda e: lambda t: t("part").select(F.col("p_partkey"), e(StringExpr.col("p_name")).alias("s"))
for _key, _e, _o in (
    ("concat", lambda e: e.concat("-", StringExpr.col("p_brand"), "x"), "p_name || '-' || p_brand || '-x'"),
    ("concat_null", lambda e: e.concat("-", StringExpr.const(None)), "p_name || '-'"),
    ("substring", lambda e: e.substring(1, 4), "substr(p_name, 2, 3)"),
    ("upper", lambda e: e.upper(), "upper(p_name)"),
    ("lower", lambda e: e.upper().lower(), "lower(p_name)"),
    ("title", lambda e: e.title(), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"),
    ("replace_all", lambda e: e.replace_all("a", "AA"), "replace(p_name, 'a', 'AA')"),
    ("replace_first", lambda e: e.replace("e", "E", 1), "regexp_replace(p_name, 'e', 'E')"),
    ("trim", lambda e: e.concat(" \n", " ").trim(), "p_name"),
    ("ltrim_rtrim", lambda e: e.concat("\t ", "").rtrim().ltrim(), "p_name"),
    ("split", lambda e: e.split(" ", 1), "CASE WHEN len(string_split(p_name, ' ')) > 1 THEN string_split(p_name, ' ')[2] END"),
    ("extract", lambda e: e.extract("[aeiou][a-z]"), "regexp_extract(p_name, '[aeiou][a-z]')"),
    ("repeat", lambda e: e.repeat(2), "p_name || p_name"),
    ("trim_prefix_suffix", lambda e: e.trim_prefix("a").trim_suffix("e"), "regexp_replace(regexp_replace(p_name, '^a', ''), 'e$', '')"),
    ("when_const", lambda e: e.substring(0, 1).when_const({"a": "first", "b": "second"}), "CASE p_name[1] WHEN 'a' THEN 'first' WHEN 'b' THEN 'second' ELSE p_name[1] END"),
    ("when_nil", lambda e: StringExpr(lambda _: F.expr("nullif(p_brand, 'Brand#1')")).when_nil(StringExpr.col("p_name")), "coalesce(nullif(p_brand, 'Brand#1'), p_name)"),
):
    _api(f"str_{_key}", f"SELECT p_partkey, {_o} AS s FROM part")(_str(_e))
_api("str_len", "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS s FROM documents")(lambda t: t("documents").select(F.col("doc_id"), StringExpr.col("text").len().alias("s")))
_api("str_parse_datetime", "SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') AS TIMESTAMP) AS s FROM orders")(
    lambda t: t("orders").df.select("o_orderkey", StringExpr(lambda _: F.date_format("o_orderdate", "dd/MM/yyyy")).parse_datetime("02/01/2006").value().cast("timestamp_ntz").alias("s"))
)
for _key, _s, _o in (
    ("instr", "CAST(instr(p_name, 'a') AS BIGINT)", None),
    ("length", "CAST(length(p_name) AS BIGINT)", None),
    ("case", "upper(p_name) || lower(p_type)", None),
    ("trims", "ltrim('  ' || p_name) || rtrim(p_name || '  ') || trim(' ' || p_name || ' ')", None),
    ("trim_chars", "trim('xx' || p_name || 'xx', 'x') || ltrim('xy' || p_name, 'xy') || rtrim(p_name || 'zz', 'z')", None),
    ("replace", "replace(p_name, 'e', '')", None),
    ("substr", "substr(p_name, 2, 3) || substr(p_name, 0, 3) || substr(p_name, -3) || substr(p_name, 3)", "substr(p_name, 2, 3) || substr(p_name, 1, 2) || substr(p_name, -3) || substr(p_name, 3)"),
    ("concat_sql", "concat(p_name, '/', p_brand) || p_type", None),
    ("abs", "abs(p_size - 25)", None),
    ("char", "char(65, 66, p_size + 60)", "chr(65) || chr(66) || chr(p_size + 60)"),
    ("glob_like_fn", "(glob('*a*', p_name) OR like('Brand#2%', p_brand))", "(p_name GLOB '*a*' OR p_brand LIKE 'Brand#2%')"),
    ("hex", "hex(p_brand)", None),
    ("likely", "likely(p_size > 3) AND likelihood(p_size < 40, 0.9)", "p_size > 3 AND p_size < 40"),
    ("unicode", "unicode(p_name)", None),
    ("printf", "printf('%s-%d', p_brand, p_size)", None),
    ("printf_float", "printf('%05.2f|%5d|%-4s|', p_retailprice / 3.5, p_size, 'x')", None),
    ("format", "format('%s/%d', p_brand, p_size)", "printf('%s/%d', p_brand, p_size)"),
    ("zeroblob", "hex(zeroblob(p_size % 3)) || CAST(length(randomblob(5)) AS STRING)", "repeat('00', p_size % 3) || '5'"),
    ("quote", "quote(p_brand)", "'''' || p_brand || ''''"),
):
    _sql(f"str_{_key}", f"SELECT p_partkey, {_s} AS s FROM part", f"SELECT p_partkey, {_o or _s} AS s FROM part")
_sql("str_soundex", "SELECT soundex('Robert') AS a, soundex('Rupert') AS b", "SELECT 'R163' AS a, 'R163' AS b")
_sql("str_typeof", "SELECT typeof(1) AS i, typeof('a') AS t, typeof(1.5) AS r, typeof(NULL) AS n", "SELECT 'integer' AS i, 'text' AS t, 'real' AS r, 'null' AS n")
_sql("udf_text_extract", "SELECT doc_id, text_extract(text, 1) AS a, text_extract(text, 100000) AS b FROM documents", "SELECT doc_id, coalesce(string_split(text, ' ')[2], '') AS a, coalesce(string_split(text, ' ')[100001], '') AS b FROM documents")

# ---------------------------------------------------------------- numbers and conditions
_api("math_int_ops", "SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - 3 AS s, o_orderkey * 2 AS m, o_orderkey // nullif(o_custkey, 0) AS d FROM orders")(
    lambda t: (lambda k: t("orders").select("o_orderkey", k.op("+", IntExpr.col("o_custkey")).alias("a"), k.op_const("-", 3).alias("s"), k.op_const("*", 2).alias("m"), k.op("/", IntExpr.col("o_custkey")).alias("d")))(IntExpr.col("o_orderkey"))
)
_api("math_double_ops", "SELECT o_orderkey, o_totalprice + 1 AS a, o_totalprice / 2 AS d FROM orders")(lambda t: t("orders").select("o_orderkey", DoubleExpr.col("o_totalprice").op_const("+", 1.0).alias("a"), DoubleExpr.col("o_totalprice").op_const("/", 2.0).alias("d")))
_api("math_when", f"SELECT o_orderkey, CASE coalesce(m, -1) WHEN 1 THEN 100 ELSE coalesce(m, -1) END AS w FROM {_NULLS}")(lambda t: _nulls(t).select("o_orderkey", IntExpr.col("m").when_nil(F.lit(-1).cast("long")).when_const({1: 100}).alias("w")))
_api("bool_when_nil", f"SELECT o_orderkey, coalesce(m > 2, true) AS b FROM {_NULLS}")(lambda t: Frame(_nulls(t).df.select("o_orderkey", (F.col("m") > 2).alias("b"))).select("o_orderkey", BoolExpr.col("b").when_nil(True).alias("b")))
_sql("math_div_by_zero", "SELECT o_orderkey, o_orderkey / nullif(o_orderkey % 2, 0) AS q FROM orders")
for _key, _s, _o in (
    ("trig", "ROUND(sin(p_size) + cos(p_size) + tan(p_size), 6)", None), ("inverse_trig", "ROUND(asin(p_size / 60.0) + acos(p_size / 60.0) + atan(p_size) + atan2(p_size, 2), 6)", None),
    ("hyperbolic", "ROUND(sinh(p_size / 50.0) + cosh(p_size / 50.0) + tanh(p_size) + asinh(p_size) + acosh(p_size + 1) + atanh(p_size / 60.0), 3)", None),
    ("rounding", "CAST(ceil(p_retailprice) + floor(p_retailprice) + ceiling(p_retailprice) AS BIGINT)", None), ("trunc", "trunc(p_retailprice)", "CAST(trunc(p_retailprice) AS BIGINT)"), ("angles", "ROUND(degrees(p_size) + radians(p_size) + pi(), 6)", None),
    ("logs", "ROUND(exp(p_size / 50.0) + ln(p_size + 1) + log(p_size + 1) + log10(p_size + 1) + log2(p_size + 1), 6)", None), ("powers", "ROUND(pow(p_size, 2) + power(p_size, 0.5) + sqrt(p_size) + mod(p_size, 7), 6)", None),
    ("scalar_max_min", "max(p_size, 20, 10) + min(p_size, 20)", "greatest(p_size, 20, 10) + least(p_size, 20)"), ("scalar_max_null", "max(p_size, NULL, 10)", "CAST(NULL AS INT)"), ("round", "round(p_retailprice, 1)", None), ("bits", "(p_size & 12) | (p_size << 2) | (p_size >> 1) | (p_size % 5)", None),
):
    _sql(f"math_{_key}", f"SELECT p_partkey, {_s} AS v FROM part", f"SELECT p_partkey, {_o or _s} AS v FROM part")
_sql("cond_null_functions", f"SELECT o_orderkey, coalesce(m, k, 0) AS a, ifnull(m, -1) AS b, nullif(o_orderkey, 5) AS c, iif(m > 2, 'x', 'y') AS d FROM {_NULLS} n", f"SELECT o_orderkey, coalesce(m, k, 0) AS a, ifnull(m, -1) AS b, nullif(o_orderkey, 5) AS c, CASE WHEN m > 2 THEN 'x' ELSE 'y' END AS d FROM {_NULLS} n")

# ---------------------------------------------------------------- dates
_dt = lambda e: lambda t: t("orders").select("o_orderkey", e(DatetimeExpr.col("o_orderdate")).alias("v"))
for _part in ("year", "month", "day", "hour", "minute", "second"):
    _api(f"dt_{_part}", f"SELECT event_id, CAST({_part}(ts) AS BIGINT) AS v FROM events")(lambda t, p=_part: t("events").select("event_id", getattr(DatetimeExpr.col("ts"), p)().alias("v")))
_api("dt_unix_milli", "SELECT event_id, epoch_us(ts) // 1000 AS v FROM events")(lambda t: t("events").select("event_id", DatetimeExpr.col("ts").unix_milli().alias("v")))
_api("dt_add_date", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + INTERVAL 14 MONTH AS TIMESTAMP) + to_days(CAST(day(o_orderdate) AS INT) - 1 + 3) AS v FROM orders")(lambda t: t("orders").df.select("o_orderkey", DatetimeExpr.col("o_orderdate").add_date(1, 2, 3).value().cast("timestamp_ntz").alias("v")))
_api("dt_add_time", "SELECT event_id, ts + INTERVAL 1 HOUR + INTERVAL 2 MINUTE + INTERVAL 3 SECOND AS v FROM events")(lambda t: t("events").select("event_id", DatetimeExpr.col("ts").add_time(1, 2, 3).alias("v")))
_api("dt_format", "SELECT o_orderkey, strftime(o_orderdate, '%d %b %Y') AS v FROM orders")(_dt(lambda e: e.format_as("02 Jan 2006")))
_sql("dt_sql_functions", "SELECT o_orderkey, date(o_orderdate) AS d, datetime(o_orderdate, '+1 day') AS t, strftime('%Y/%m/%d %H', o_orderdate) AS f, date(o_orderdate, 'start of month', '+1 month', '-1 day') AS e FROM orders",
     "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS t, strftime(o_orderdate, '%Y/%m/%d %H') AS f, strftime(last_day(o_orderdate), '%Y-%m-%d') AS e FROM orders")
_sql("dt_julianday", "SELECT event_id, ROUND(julianday(ts), 5) AS v, strftime('%j', ts) AS j FROM events", "SELECT event_id, ROUND(julian(ts) - 0.5, 5) AS v, strftime(ts, '%j') AS j FROM events")


# ---------------------------------------------------------------- the caller's own operations and functions
_api("user_expr_ops", "SELECT o_orderkey, o_custkey * 10 + 7 AS v FROM orders WHERE o_custkey % 3 = 1")(
    lambda t: t("orders").where_row(IntExpr.col("o_custkey").filter_op(lambda c, n: c % n == 1, 3).predicate()).select("o_orderkey", IntExpr.col("o_custkey").map_op(lambda c, a, b: c * a + b, 10, IntExpr.const(7)).alias("v"))
)
_api("user_reduce_op", "SELECT o_orderstatus, max(o_custkey) - min(o_custkey) AS s FROM orders GROUP BY o_orderstatus")(lambda t: t("orders").group("o_orderstatus").agg(IntExpr.col("o_custkey").reduce_op(lambda c: F.max(c) - F.min(c)).alias("s")))


@_api("user_sql_function", "SELECT n_nationkey, reverse(n_name) || '!' AS v FROM nation")
def _user_function(t):
    nation = t("nation").df
    register_function(nation.sparkSession, "backwards", lambda s: None if s is None else s[::-1] + "!", "string")
    return run_sql(nation.sparkSession, "SELECT n_nationkey, backwards(n_name) AS v FROM nation", {"nation": nation})


# ---------------------------------------------------------------- sources and sinks
def _source(key: str, oracle: str, url: str, table: str = "nation", config: dict | None = None, text: str = "", many: int = 1) -> None:
    """A driver table written through the sinks (or, where they refuse, as bytes) and read back through the sources."""

    @_api(f"src_{key}", oracle)
    def _round(t):
        made = t(table)
        spark = made.df.sparkSession
        base = f"{shared_dir(spark)}/millrace-sources/{uuid.uuid4().hex}"
        for i in range(many):
            target = base + "/" + url.format(i).partition("#")[0]
            if text:
                packed(spark, made, target.partition("?")[0], text)
            else:
                write_source(made, config, target)
        return read_sources(spark, config, f"{base}/{url.replace('{}', '*')}")[0]


_STRINGS = "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation"
_DOUBLES = "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation"
_source("csv", _STRINGS, "n.csv")
_source("csv_lines", _STRINGS, "n.csv?csv.sep=;&csv.lines=true")
_source("tsv_no_header", "SELECT CAST(n_nationkey AS VARCHAR) AS c0, n_name AS c1, CAST(n_regionkey AS VARCHAR) AS c2 FROM nation", "n.csv?csv.hasHeader=false;csv.sep=tab")
_source("csv_glob", f"{_STRINGS} UNION ALL {_STRINGS} UNION ALL {_STRINGS}", "n{}.csv#n", many=3)
_source("csv_folder", _STRINGS, "folder.csv/")
_source("csv_gzip", _STRINGS, "n.csv.gz", text="gz")
_source("csv_zip", f"{_STRINGS} UNION ALL {_STRINGS}", "n.csv.zip", text="zip")
_source("csv_snappy", _STRINGS, "n.csv.snappy", text="snappy")
_source("json_lines", _DOUBLES, "n.json")
_source("json_whole", _DOUBLES, "n.json", config={"json.objectOnEachLine": "false"})
_source("json_root", _DOUBLES, "n.json?json.rootNode=rows&json.objectOnEachLine=false", text="root")
_source("xml", _STRINGS, "n.xml?xml.elementName=row")
_source("parquet", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation", "n.parquet")
_source("text", "SELECT n_name AS text, CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS rowNumber_ FROM nation", "n.txt", text="text")

# ---------------------------------------------------------------- event-time windows (extension)
_api("event_tumbling", "SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, CAST(COUNT(*) AS BIGINT) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY ALL")(
    lambda t: windowed(t("events").df, "ts", ["event_type"], "1 hour", value="value").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
)
_api("event_sessions", "SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL 30 MINUTE AS end, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT *, SUM(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, s")(
    lambda t: sessions(t("events").df, "ts", "user_id", "30 minutes").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
)
