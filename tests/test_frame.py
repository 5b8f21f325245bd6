"""The programmatic API: frames, series, grouped frames and typed expressions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.functions import types as T
from millrace.functions.exprs import BoolExpr, DatetimeExpr, DoubleExpr, IntExpr, StringExpr
from millrace.functions.layouts import from_reference
from millrace.operators.frame import CROSS_JOIN, EQUI_JOIN, LEFT_JOIN, OUTER_JOIN, RIGHT_JOIN, Frame, FrameError, Series, row_index


@pytest.fixture
def df1(spark):
    return Frame.from_rows(spark, [(i, float(i), f"a{i}") for i in range(1, 5)], [("c1", "integer"), ("c2", "double"), ("c3", "string")], "df1")


def rows(f):
    return sorted((tuple(r) for r in (f.df if hasattr(f, "df") else f).collect()), key=repr)


def values(s):
    return [r[0] for r in s.df.collect()]


def test_columns(df1):
    f = df1.add_series("c4", F.col("c1") * 2)
    assert f.schema()[-1] == ("c4", "integer") and [r[3] for r in rows(f)] == [2, 4, 6, 8]
    with pytest.raises(FrameError):
        f.add_series("C1", F.lit(1))
    assert f.rename_series("c4", "d").columns[-1] == "d" and f.columns[-1] == "c4"
    with pytest.raises(FrameError):
        f.rename_series("c4", "c1")
    assert f.remove_series("c4", 0).columns == ["c2", "c3"]
    assert f.update_series("c1", F.col("c3")).schema()[0] == ("c1", "string")
    assert f.select_by_index(2, 0).columns == ["c3", "c1"] and f.select_by_name("C3").columns == ["c3"]
    with pytest.raises(FrameError):
        f.select_by_name("nope")
    assert df1.rename("x").name == "x" and df1.get_series_expr("c1").format == "integer"


def test_positional_series_with_more_rows_than_columns(spark):
    n = 500
    left = Frame.from_series(Series.range(spark, n, name="a"), name="f")
    f = left.add_series("b", Series.range(spark, n, name="x").select(IntExpr.root().op_const("+", 7)))
    assert all(r["b"] == r["a"] + 7 for r in f.df.collect()) and len(f) == n


def test_rows(df1):
    assert len(df1) == 4 and df1.get_row(1)["c3"] == "a2" and df1.get_value(0, "C2") == 1.0
    with pytest.raises(FrameError):
        df1.get_row(9)
    assert len(df1.limit(1, 2)) == 2 and len(df1.limit(3, 5)) == 1
    seen = []
    df1.for_each_row(lambda r: seen.append(r["c1"]))
    assert seen == [1, 2, 3, 4]
    assert rows(df1.map_row("x long", lambda r: (r["c1"] + 1,))) == [(2,), (3,), (4,), (5,)]
    assert len(df1.flat_map_row("x long", lambda r: [(r["c1"],)] * 2)) == 8
    assert len(df1.where_row(lambda r: r["c1"] > 2)) == len(df1.where_row(IntExpr.col("c1").gt(2))) == len(df1.where_row(F.col("c1") > 2)) == 2


def test_sort_is_lexicographic(spark):
    f = Frame.from_rows(spark, [(1, "b"), (2, "a"), (1, "a"), (None, "z")], [("k", "int"), ("s", "text")])
    assert [tuple(r) for r in f.sort("k", ("s", False)).df.collect()] == [(None, "z"), (1, "b"), (1, "a"), (2, "a")]


def test_values(spark, df1):
    f = Frame.from_rows(spark, [(None, "x"), (2, None)], [("a", "int"), ("b", "string")])
    assert rows(f.when_nil({"a": 0, "b": "-"})) == [(0, "x"), (2, "-")]
    assert rows(f.when({"b": {"x": "y"}, "a": {2: 20}})) == [(20, None), (None, "y")]
    assert df1.as_format({"c1": "string", "c2": "integer"}).schema()[:2] == [("c1", "string"), ("c2", "integer")]


def test_sets(spark, df1):
    assert len(df1.append(df1)) == len(df1.union(df1)) == 8
    with pytest.raises(FrameError):
        df1.append(df1.remove_series(0))
    a, b = (Frame.from_series(Series.range(spark, n, name="s")) for n in (100000, 100))
    assert len(a.intersection(b)) == 100 and len(a.except_(b)) == 99900
    assert len(df1.append(df1).distinct()) == 4 and len(df1.append(df1).distinct("c1")) == 4
    assert len(df1.intersection(df1.limit(0, 2), "c1")) == 2 and len(df1.except_(df1.limit(0, 1), "c3")) == 3


def test_groups(spark):
    f = Frame.from_rows(spark, [(k, float(k), f"a{k}") for k in (1, 2, 3, 4, 1)], [("c1", "int"), ("c2", "double"), ("c3", "string")])
    g = f.group("c1")
    assert len(g) == 4 and len(g.get(1)) == 2 and g.get_group_columns() == ["c1"]
    # keys are exact: ("1", "23") is not ("12", "3")
    h = Frame.from_rows(spark, [("1", "23"), ("12", "3")], [("a", "text"), ("b", "text")]).group("a", "b")
    assert len(h) == 2
    assert rows(g.map(lambda k, p: p.assign(c2=p.c2 * 10)[["c1", "c2"]], "c1 long, c2 double")) == [(1, 10.0), (1, 10.0), (2, 20.0), (3, 30.0), (4, 40.0)]
    assert len(g.where(F.count(F.lit(1)) > 1)) == 2
    seen = []
    g.for_each(lambda k, x: seen.append((k[0], len(x))))
    assert sorted(seen) == [(1, 2), (2, 1), (3, 1), (4, 1)]
    assert rows(g.agg(DoubleExpr.col("c2").agg_mean().alias("m"))) == [(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)]


def test_joins(spark, df1):
    twice = df1.append(df1)
    assert len(df1.join(twice, EQUI_JOIN, {"c1": "c1"})) == 8 and len(df1.join(twice, CROSS_JOIN)) == 32
    a = Frame.from_rows(spark, [(1, "x"), (None, "n")], [("k", "int"), ("v", "text")])
    b = Frame.from_rows(spark, [(None, "N"), (2, "Z")], [("k", "int"), ("w", "text")])
    assert rows(a.join(b, EQUI_JOIN, {"k": "k"})) == [(None, "n", None, "N")]
    assert len(a.join(b, LEFT_JOIN, {"k": "k"})) == len(a.join(b, RIGHT_JOIN, {"k": "k"})) == 2 and len(a.join(b, OUTER_JOIN, {"k": "k"})) == 3
    assert a.join(b, EQUI_JOIN, {"k": "k"}, combine=lambda d: d.select("v", "w")).columns == ["v", "w"]
    assert len(df1.join(twice, RIGHT_JOIN, by_position=True)) == 8 and len(df1.join(twice, EQUI_JOIN, by_position=True)) == 4
    with pytest.raises(FrameError):
        a.join(b)


def test_row_index_follows_partitions(spark):
    df = row_index(spark.range(0, 1000, 1, 7), "i")
    assert all(r["id"] == r["i"] for r in df.collect())


def test_series(spark):
    s = Series.of(spark, "int", [1, 2, 3, 4, 1, 1])
    assert (s.sum(), s.min(), s.max(), s.mean(), s.median()) == (12.0, 1, 4, 2.0, 1.5)
    assert {tuple(r) for r in s.count_distinct_values().collect()} == {(1, 3), (2, 1), (3, 1), (4, 1)}
    assert Series.of(spark, "double", [1.0, 2.0, 3.0, 4.0]).median() == 2.5
    assert sorted(values(s.distinct())) == [1, 2, 3, 4] and values(s.sort(False))[0] == 4
    assert values(s.map("string", lambda v: f"<{v}>"))[0] == "<1>" and len(s.flat_map("int", lambda v: [v] * v)) == 12
    assert s.reduce(lambda a, b: a + b, F.lit(0).cast("long")) == 12
    a, b = Series.range(spark, 10), Series.of(spark, "int", [3, 4, 99])
    assert sorted(values(a.intersection(b))) == [3, 4] and len(a.except_(b)) == 8 and len(a.append(b)) == 13
    assert sorted(values(Series.range(spark, 11, 5, 3))) == [5, 8] and values(Series.constant(spark, "k", 2)) == ["k", "k"]
    assert a.join(b).count() == 3 and a.join(b, CROSS_JOIN).count() == 30
    with pytest.raises(FrameError):
        a.append(Series.of(spark, "string", ["x"]))
    with pytest.raises(FrameError):
        a.select(IntExpr.root().agg_sum())
    assert a.agg(IntExpr.root().agg_sum()) == 45 and a.agg(IntExpr.root().agg_mean()) == 4.5 and a.agg(IntExpr.root().agg_min()) == 0


def ints(spark):
    return Series.of(spark, "int", [1, 2, 3, 4, 5, 1, None])


@pytest.mark.parametrize(
    ("e", "n"),
    [
        (lambda e: e.in_const(1, 2, 3).eq_const(2), 1), (lambda e: e.not_in_const(1, 2), 3), (lambda e: e.eq(None), 1), (lambda e: e.ne(5), 6), (lambda e: e.lt_const(3), 3), (lambda e: e.ge_const(4), 2), (lambda e: e.gt(IntExpr.const(4)), 1), (lambda e: e.le(1), 2),
        (lambda e: e.between(1, 5), 6), (lambda e: e.between(1, 5, "left"), 5), (lambda e: e.between(1, 5, "right"), 4), (lambda e: e.between(1, 5, "neither"), 3), (lambda e: e.non_nil(), 6), (lambda e: e.when_nil(9).eq_const(9), 1), (lambda e: e.op_const("*", 2).eq_const(10), 1),
    ],
)
def test_int_filters(spark, e, n):
    assert len(ints(spark).select(e(IntExpr.root()))) == n


def test_numbers(spark):
    assert values(Series.of(spark, "int", [7, -7, None]).select(IntExpr.root().op("/", 2))) == [3, -3, None]
    assert values(Series.of(spark, "double", [1.0, None]).select(DoubleExpr.root().op("/", 0.0))) == [None, None]
    assert values(Series.of(spark, "int", [1, 2]).select(IntExpr.root().when_const({1: 100}))) == [100, 2]
    assert len(Series.of(spark, "double", [1.0, 2.0, None]).select(DoubleExpr.root().ge_const(2.0))) == 1


@pytest.mark.parametrize(
    ("e", "given", "want"),
    [
        (lambda e: e.concat(",", "x", StringExpr.const(None)), ["a", None], ["a,x,", ",x,"]), (lambda e: e.concat(","), ["a"], ["a"]), (lambda e: e.substring(1, 3), ["hello"], ["el"]), (lambda e: e.title(), ["hello wORLD"], ["Hello WORLD"]), (lambda e: e.replace_all("a", "b"), ["aca"], ["bcb"]), (lambda e: e.replace("a", "b", 1), ["aca"], ["bca"]), (lambda e: e.replace("a", "b", 0), ["aca"], ["aca"]), (lambda e: e.replace(".", "b", 1), ["a.a."], ["aba."]),
        (lambda e: e.trim(), [" \n a\t"], ["a"]), (lambda e: e.ltrim(), [" \t\na"], ["\na"]), (lambda e: e.rtrim(), ["a\f \n"], ["a\f \n"]), (lambda e: e.split("|", 1), ["a|b", "a"], ["b", None]), (lambda e: e.extract("[0-9]+"), ["ab12c3", "x"], ["12", ""]), (lambda e: e.repeat(2), ["ab"], ["abab"]), (lambda e: e.trim_suffix("bc"), ["abc", "bcd"], ["a", "bcd"]), (lambda e: e.trim_prefix("ab"), ["abc", "cab"], ["c", "cab"]),
        (lambda e: e.when_const({"a": "z"}), ["a", "b", None], ["z", "b", None]), (lambda e: e.when_nil("n"), [None], ["n"]), (lambda e: e.len(), ["é", None], [2, 0]), (lambda e: e.upper().lower(), ["Ab"], ["ab"]), (lambda e: e.as_format("integer"), ["1.9", "-2"], [1, -2]), (lambda e: e.as_format("boolean"), ["t", "0"], [True, False]),
        (lambda e: e.not_in_const("a"), ["a", "b", None], ["b"]), (lambda e: e.ne("a"), ["a", "b", None], ["b"]), (lambda e: e.eq(StringExpr.const(None)), [None], []), (lambda e: e.contains("b"), ["abc", None], ["abc"]), (lambda e: e.starts_with("a").ends_with("c"), ["abc", "ab"], ["abc"]),
    ],
)
def test_strings(spark, e, given, want):
    s = Series.of(spark, "string", given)
    p = e(StringExpr.root())
    got = s.df.select(p.value(s.column).alias("v")) if p.predicate(s.column) is None else s.select(p).df
    assert [r[0] for r in got.collect()] == want


def test_booleans_are_two_valued(spark):
    f = Frame.from_rows(spark, [(True, None), (None, True), (True, True), (False, True)], [("p", "bool"), ("q", "bool")])
    got = f.select(BoolExpr.col("p").and_(BoolExpr.col("q")).alias("a"), BoolExpr.col("p").or_(BoolExpr.col("q")).alias("o"), BoolExpr.col("p").not_().alias("n"))
    assert [tuple(r) for r in got.df.collect()] == [(False, False, False), (False, False, False), (True, True, False), (False, True, True)]


def test_datetimes(spark):
    s = Series.of(spark, "datetime", [dt.datetime(2011, 1, 31, 10, 20, 30), None])
    v = lambda e: s.df.select(e(DatetimeExpr.root()).value(s.column).alias("v")).collect()[0][0]
    assert [v(lambda e, p=p: getattr(e, p)()) for p in ("year", "month", "day", "hour", "minute", "second")] == [2011, 1, 31, 10, 20, 30]
    assert v(lambda e: e.add_date(0, 1, 0)) == dt.datetime(2011, 3, 3, 10, 20, 30)
    assert v(lambda e: e.add_date(1, None, 1)) == dt.datetime(2012, 2, 1, 10, 20, 30) and v(lambda e: e.add_time(14, 0, 30)) == dt.datetime(2011, 2, 1, 0, 21, 0)
    assert v(lambda e: e.format_as("2006-01-02 at 15h")) == "2011-01-31 at 10h" and v(lambda e: e.unix_milli()) == 1296469230000
    t = Series.of(spark, "string", ["31/01/2011", "bad"])
    assert [r[0] for r in t.df.select(StringExpr.root().parse_datetime("02/01/2006").value(t.column)).collect()] == [dt.datetime(2011, 1, 31), None]
    assert from_reference("Mon Jan _2 15:04:05 2006") == "EEE MMM d HH:mm:ss yyyy"


def test_conversions(spark):
    def one(value, source, target, **k):
        return Series.of(spark, source, [value]).df.select(T.convert(F.col("value"), source, target, **k)).first()[0]

    assert one(1.0, "double", "string") == "1" and one(1.5, "double", "string") == "1.5" and one(-1.9, "double", "integer") == -1 and one(True, "bool", "integer") == 1 and one(3, "int", "boolean") is True and one(True, "bool", "string") == "true"
    assert one("x", "string", "double", strict=False) is None and one(1.0, "double", "boolean") is True and one("2020-01-02", "string", "datetime") == dt.datetime(2020, 1, 2) and one(5, "int", "datetime") is None
    with pytest.raises(Exception, match="cannot convert"):
        one("x", "string", "integer")
    assert T.get_format("UINT8") == "integer" and T.get_format("time") == "datetime"
    with pytest.raises(T.FormatError):
        T.get_format("nope")


def test_reduce_in_runs(spark, monkeypatch):
    values = Series.of(spark, "string", list("abcdefghij"), "v")
    assert values.reduce(lambda a, x: F.concat(a, x), "") == "abcdefghij"
    monkeypatch.setattr(Series, "RUN", 3)
    assert values.reduce(lambda a, x: F.concat(a, x), "", merge=lambda a, b: F.concat(a, b)) == "abcdefghij"
    with pytest.raises(FrameError):
        values.reduce(lambda a, x: F.concat(a, x), "")
    assert Series(spark.createDataFrame([], "v string")).reduce(lambda a, x: F.concat(a, x), "s", merge=lambda a, b: F.concat(a, b)) == "s"
