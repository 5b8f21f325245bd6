"""Named frames and series over Spark DataFrames: the programmatic API.

Every method appends to the logical plan. Only closures over rows (``map_row``, ``flat_map_row``,
``where_row`` with a Python function, grouped ``map``) leave the JVM, in Arrow batches. Methods
that speak of positions need an order: they number rows by ``row_index``, in scan order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST
from pyspark.sql import Window as W

from ..functions import types as T
from ..functions.exprs import BUILDERS, Expr

LEFT_JOIN, EQUI_JOIN, RIGHT_JOIN, OUTER_JOIN, CROSS_JOIN = "left", "equi", "right", "outer", "cross"
_HOW = {LEFT_JOIN: "left", EQUI_JOIN: "inner", RIGHT_JOIN: "right", OUTER_JOIN: "full"}


class FrameError(ValueError):
    """Misuse of a frame: a missing or repeated column, or schemas that differ."""


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_index(df: DataFrame, name: str = "_index") -> DataFrame:
    """Number rows from 0 in scan order: each partition's rows follow those of the partitions before it.

    Two passes: a count for each partition (one small row each), then local numbers plus offsets.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    counts = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    joined = tagged.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("_mid", "_part", "_before")


#: A self-join of more pairs is dealt out by blocks: rows of one key in a block, on average, and pairs in a task.
BLOCK, PAIRS = 1024, 1 << 23


def pair_blocks(df: DataFrame, key: str, left: str, right: str) -> tuple[DataFrame, DataFrame] | None:
    """Both sides of an inner join of a table with itself on ``key``, dealt out so that pairs spread over tasks.

    Each row falls into one block of its key's rows and is repeated for every block of the other side; the columns ``left`` and
    ``right`` say which blocks meet, so that each pair of rows of one key meets once when they are joined on too. The number of tasks
    grows with the number of pairs, which a job counts first. None: there are at most PAIRS.
    """
    k = _q(key)
    rows = df.where(k.isNotNull())
    counts = rows.groupBy(k.alias("_pair_key")).agg(F.count(F.lit(1)).alias("_pair_n"))
    pairs = counts.agg(F.sum(F.col("_pair_n").cast("double") * F.col("_pair_n"))).first()[0] or 0
    if pairs <= PAIRS:
        return None
    # one row for BLOCK rows of the table at most
    blocks = F.broadcast(counts.where(F.col("_pair_n") > BLOCK).select("_pair_key", F.ceil(F.col("_pair_n") / BLOCK).cast("int").alias("_pair_blocks")))
    # a task repeats about a million rows
    placed = rows.withColumn("_pair_row", F.monotonically_increasing_id()).repartition(math.ceil(pairs / BLOCK / (1 << 20)), "_pair_row")
    placed = placed.join(blocks, k == F.col("_pair_key"), "left").withColumn("_pair_blocks", F.coalesce("_pair_blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("_pair_row"), "_pair_blocks").cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_pair_blocks") - 1))
    columns = [_q(c) for c in df.columns]
    side = lambda mine, other: placed.select(*columns, own.alias(mine), every.alias(other)).repartition(math.ceil(pairs / PAIRS), k, F.col(left), F.col(right))
    return side(left, right), side(right, left)


class Frame:
    """A DataFrame with a name."""

    def __init__(self, df: DataFrame, name: str = ""):
        self.df, self.name = df, name

    # construction
    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Iterable, schema: list[tuple[str, str]], name: str = "") -> Frame:
        fields = ST.StructType([ST.StructField(n, T.SPARK_TYPES[T.get_format(f)]) for n, f in schema])
        return cls(spark.createDataFrame(list(rows), fields), name)

    @classmethod
    def from_series(cls, *series: Series, name: str = "") -> Frame:
        """Columns side by side, by position; lengths must agree."""
        first = cls(series[0].df, name)
        return reduce(lambda f, s: f.add_series(s.name, s), series[1:], first)

    @classmethod
    def merge(cls, *frames: Frame, name: str = "") -> Frame:
        """Rows of all frames; columns by position under the first one's names."""
        return cls(reduce(DataFrame.union, [f.df for f in frames]), name or frames[0].name)

    # shape
    def rename(self, name: str) -> Frame:
        return Frame(self.df, name)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def schema(self) -> list[tuple[str, str]]:
        return T.schema_text(self.df)

    def __len__(self) -> int:
        return self.df.count()

    def _name(self, column: str | int) -> str:
        """A column by ordinal or by name, case aside."""
        if isinstance(column, int):
            if not 0 <= column < len(self.columns):
                raise FrameError(f"no column {column}")
            return self.columns[column]
        for c in self.columns:
            if c.lower() == column.lower():
                return c
        raise FrameError(f"no column {column}")

    def _new(self, df: DataFrame) -> Frame:
        return Frame(df, self.name)

    # columns
    def select(self, *exprs: Expr | Column | str) -> Frame:
        """Expressions; their filters restrict the rows first."""
        df, out = self.df, []
        for e in exprs:
            if isinstance(e, Expr):
                p = e.predicate(rows=True)
                df = df if p is None else df.where(p)
                c = e.value()
                out.append(c if e._alias or not e._name else c.alias(e._name))
            else:
                out.append(e)
        return self._new(df.select(*out))

    def select_by_index(self, *at: int) -> Frame:
        return self._new(self.df.select(*[_q(self._name(i)) for i in at]))

    def select_by_name(self, *names: str) -> Frame:
        return self._new(self.df.select(*[_q(self._name(n)) for n in names]))

    def add_series(self, name: str, what: Series | Expr | Column) -> Frame:
        """A derived column, or a series of equal length, row by row."""
        if name.lower() in (c.lower() for c in self.columns):
            raise FrameError(f"column {name} exists")
        if isinstance(what, Series):
            return self._new(_zip(self.df, what.df.select(_q(what.name).alias(name))))
        return self._new(self.df.withColumn(name, what.value() if isinstance(what, Expr) else what))

    def update_series(self, column: str | int, what: Expr | Column | Series) -> Frame:
        old = self._name(column)
        if isinstance(what, Series):
            new = _zip(self.df.drop(old), what.df.select(_q(what.name).alias(old)))
            return self._new(new.select(*self.columns))
        return self._new(self.df.withColumn(old, what.value(_q(old)) if isinstance(what, Expr) else what))

    def rename_series(self, column: str | int, name: str) -> Frame:
        old = self._name(column)
        if name.lower() != old.lower() and name.lower() in (c.lower() for c in self.columns):
            raise FrameError(f"column {name} exists")
        return self._new(self.df.withColumnRenamed(old, name))

    def remove_series(self, *columns: str | int) -> Frame:
        return self._new(self.df.drop(*[self._name(c) for c in columns]))

    def as_format(self, formats: dict[str, str], strict: bool = True) -> Frame:
        now = dict(self.schema())
        names = {self._name(c): f for c, f in formats.items()}
        return self._new(self.df.withColumns({c: T.convert(_q(c), now[c], f, strict) for c, f in names.items()}))

    def when_nil(self, values: dict[str, Any]) -> Frame:
        return self._new(self.df.withColumns({self._name(c): F.coalesce(_q(self._name(c)), F.lit(v)) for c, v in values.items()}))

    def when(self, values: dict[str, dict]) -> Frame:
        """Replace values of columns."""
        now = dict(self.schema())
        return self._new(self.df.withColumns({c: BUILDERS[now[c]].col(c).when_const(m).value() for c, m in ((self._name(k), m) for k, m in values.items())}))

    def get_series(self, column: str | int) -> Series:
        name = self._name(column)
        return Series(self.df.select(_q(name)), name)

    def get_series_expr(self, column: str | int) -> Expr:
        name = self._name(column)
        return BUILDERS[dict(self.schema())[name]].col(name)

    # rows
    def map_row(self, schema: str | ST.StructType, f: Callable[[dict], dict | tuple]) -> Frame:
        return self.flat_map_row(schema, lambda row: [f(row)])

    def flat_map_row(self, schema: str | ST.StructType, f: Callable[[dict], Iterable[dict | tuple]]) -> Frame:
        """Rows of each row, by a closure over a dict of its values, in Arrow batches."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = self.df.sparkSession.createDataFrame([], schema).schema
        arrow, names = to_arrow_schema(kind), kind.names

        def run(batches: Iterator):
            for b in batches:
                out = [dict(zip(names, r, strict=True)) if not isinstance(r, dict) else r for row in b.to_pylist() for r in f(row)]
                yield pa.RecordBatch.from_pylist(out, arrow)

        return self._new(self.df.mapInArrow(run, kind))

    def where_row(self, condition: Column | Expr | Callable[[dict], bool]) -> Frame:
        if isinstance(condition, Expr):
            p = condition.predicate(rows=True)
            return self._new(self.df.where(condition.value() if p is None else p))
        if isinstance(condition, Column):
            return self._new(self.df.where(condition))
        import pyarrow as pa

        def run(batches: Iterator):
            for b in batches:
                yield b.filter(pa.array([bool(condition(row)) for row in b.to_pylist()], pa.bool_()))

        return self._new(self.df.mapInArrow(run, self.df.schema))

    where = where_row

    def sort(self, *keys: tuple[int | str, bool] | int | str) -> Frame:
        """By several keys in turn, (column, ascending) or a column; nulls first when ascending."""
        pairs = [k if isinstance(k, tuple) else (k, True) for k in keys]
        return self._new(self.df.orderBy(*[_q(self._name(c)).asc_nulls_first() if up else _q(self._name(c)).desc_nulls_last() for c, up in pairs]))

    sort_by_name = sort

    def limit(self, offset: int, size: int) -> Frame:
        return self._new(self.df.offset(offset).limit(size))

    def get_row(self, i: int) -> Row:
        rows = self.df.offset(i).limit(1).collect()
        if not rows:
            raise FrameError(f"no row {i}")
        return rows[0]

    def get_value(self, i: int, column: str | int) -> Any:
        return self.get_row(i)[self._name(column)]

    def for_each_row(self, f: Callable[[Row], None]) -> None:
        """On the driver, a partition at a time."""
        for row in self.df.toLocalIterator():
            f(row)

    # sets
    def append(self, other: Frame) -> Frame:
        if not T.same_schema(self.df, other.df):
            raise FrameError("schemas differ")
        return self._new(self.df.union(other.df))

    union = append

    def intersection(self, other: Frame, *columns: str) -> Frame:
        """Distinct rows in both; nulls are equal. With columns, rows whose values there are in the other."""
        if columns:
            return self._new(self._semi(other, columns, "left_semi").distinct())
        return self._new(self.df.intersect(other.df))

    def except_(self, other: Frame, *columns: str) -> Frame:
        if columns:
            return self._new(self._semi(other, columns, "left_anti").distinct())
        return self._new(self.df.subtract(other.df))

    def _semi(self, other: Frame, columns: tuple[str, ...], how: str) -> DataFrame:
        right = other.df.select(*[_q(other._name(c)).alias(f"_r{i}") for i, c in enumerate(columns)]).distinct()
        on = [_q(self._name(c)).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(columns)]
        return self.df.join(right, reduce(Column.__and__, on), how)

    def distinct(self, *columns: str) -> Frame:
        return self._new(self.df.dropDuplicates([self._name(c) for c in columns]) if columns else self.df.distinct())

    # groups and joins
    def group(self, *columns: str) -> Grouped:
        return Grouped(self, [self._name(c) for c in columns])

    def join(self, other: Frame, how: str = EQUI_JOIN, on: dict[str, str] | None = None, combine: Callable[[DataFrame], DataFrame] | None = None, by_position: bool = False) -> Frame:
        """Join on column pairs (nulls equal), by position, or every pair (``cross``).

        Right-hand columns whose names clash get the suffix ``_right``. ``combine`` maps the joined frame.
        """
        taken = {c.lower() for c in self.columns}
        names = {c: c + "_right" if c.lower() in taken else c for c in other.columns}
        if by_position:
            right = other.df.select(*[_q(c).alias(n) for c, n in names.items()])
            out = _zip(self.df, right, _HOW[how])
        else:
            right = other.df.select(*[_q(c).alias(n) for c, n in names.items()])
            if how == CROSS_JOIN:
                out = self.df.crossJoin(right)
            elif not on:
                raise FrameError("a join needs columns, or by_position")
            else:
                conds = [_q(self._name(a)).eqNullSafe(_q(names[other._name(b)])) for a, b in on.items()]
                out = self.df.join(right, reduce(Column.__and__, conds), _HOW[how])
        return self._new(combine(out) if combine else out)

    def create_view(self, name: str | None = None) -> None:
        self.df.createOrReplaceTempView(name or self.name)


def _zip(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Rows side by side by position."""
    return row_index(left, "_i").join(row_index(right, "_i"), "_i", how).orderBy("_i").drop("_i")


class Grouped:
    """A frame's groups by exact keys."""

    def __init__(self, frame: Frame, keys: list[str]):
        self.frame, self.keys = frame, keys

    def get(self, *key: Any) -> Frame:
        on = [_q(k).eqNullSafe(F.lit(v)) for k, v in zip(self.keys, key, strict=True)]
        return self.frame.where_row(reduce(Column.__and__, on))

    def get_keys(self) -> DataFrame:
        return self.frame.df.select(*[_q(k) for k in self.keys]).distinct()

    def get_group_columns(self) -> list[str]:
        return list(self.keys)

    def __len__(self) -> int:
        return self.get_keys().count()

    def for_each(self, f: Callable[[tuple, Frame], None]) -> None:
        """On the driver, one key at a time; meant for few groups."""
        for key in self.get_keys().toLocalIterator():
            f(tuple(key), self.get(*key))

    def map(self, f: Callable, schema: str) -> Frame:
        """``f(key, pandas frame) -> pandas frame`` on every group."""
        return Frame(self.frame.df.groupBy(*[_q(k) for k in self.keys]).applyInPandas(f, schema), self.frame.name)

    def where(self, condition: Column) -> Frame:
        """Rows of the groups for which an aggregate condition holds; one aggregation, then a semi join."""
        keys = self.frame.df.groupBy(*[_q(k) for k in self.keys]).agg(condition.alias("_keep")).where("_keep").select(*[_q(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        on = [_q(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        return self.frame._new(self.frame.df.join(keys, reduce(Column.__and__, on), "left_semi"))

    def agg(self, *aggregates: Column | Expr) -> Frame:
        cols = [a.aggregate() if isinstance(a, Expr) else a for a in aggregates]
        return self.frame._new(self.frame.df.groupBy(*[_q(k) for k in self.keys]).agg(*cols))


class Series:
    """One named column."""

    #: Rows that one task folds.
    RUN = 100_000

    def __init__(self, df: DataFrame, name: str | None = None):
        self.df, self.name = df, name or df.columns[0]

    @classmethod
    def of(cls, spark: SparkSession, fmt: str, values: Iterable, name: str = "value") -> Series:
        return cls(spark.createDataFrame([(v,) for v in values], ST.StructType([ST.StructField(name, T.SPARK_TYPES[T.get_format(fmt)])])), name)

    @classmethod
    def range(cls, spark: SparkSession, end: int, start: int = 0, step: int = 1, name: str = "value") -> Series:
        return cls(spark.range(start, end, step).withColumnRenamed("id", name), name)

    @classmethod
    def constant(cls, spark: SparkSession, value: Any, n: int, name: str = "value") -> Series:
        return cls(spark.range(n).select(F.lit(value).alias(name)), name)

    @property
    def column(self) -> Column:
        return _q(self.name)

    @property
    def format(self) -> str:
        return T.schema_text(self.df.select(self.column))[0][1]

    def _new(self, df: DataFrame) -> Series:
        return Series(df, self.name)

    def __len__(self) -> int:
        return self.df.count()

    def expr(self) -> Expr:
        return BUILDERS[self.format].root()

    def select(self, expr: Expr) -> Series:
        """Filters of the chain restrict, maps change the value; a reduction is for ``agg``."""
        if expr.kind() == "reduce":
            raise FrameError("a reduction needs agg()")
        p = expr.predicate(self.column, rows=True)
        df = self.df if p is None else self.df.where(p)
        return self._new(df.select(expr.value(self.column).alias(self.name)))

    def agg(self, expr: Expr) -> Any:
        return self.df.agg(expr.aggregate(self.column)).first()[0]

    def where(self, condition: Column | Callable[[Any], bool]) -> Series:
        frame = Frame(self.df.select(self.column))
        name = self.name
        return self._new(frame.where_row(condition if isinstance(condition, Column) else (lambda row: condition(row[name]))).df)

    def map(self, fmt: str, f: Callable[[Any], Any]) -> Series:
        return self.flat_map(fmt, lambda v: [f(v)])

    def flat_map(self, fmt: str, f: Callable[[Any], Iterable]) -> Series:
        name = self.name
        schema = ST.StructType([ST.StructField(name, T.SPARK_TYPES[T.get_format(fmt)])])
        return self._new(Frame(self.df.select(self.column)).flat_map_row(schema, lambda row: ((v,) for v in f(row[name]))).df)

    def reduce(self, f: Callable[[Column, Column], Column], start: Any, merge: Callable[[Column, Column], Column] | None = None) -> Any:
        """Left fold in scan order with a Column function.

        With ``merge``, which joins the folds of two neighbouring runs (each from ``start``), runs of
        ``RUN`` rows are folded in parallel. Without it the whole series must be one run.
        """
        first = start if isinstance(start, Column) else F.lit(start)
        fold = lambda rows, g: F.aggregate(F.transform(F.array_sort(rows), lambda x: x["v"]), first, g)
        ordered = row_index(self.df.select(self.column), "_i").select("_i", self.column.alias("v"))
        runs = ordered.groupBy(F.floor(F.col("_i") / self.RUN).alias("_i")).agg(fold(F.collect_list(F.struct("_i", F.struct("v").alias("v"))), lambda a, x: f(a, x["v"])).alias("v"))
        if merge is None:
            found = runs.limit(2).collect()
            if len(found) > 1:
                raise FrameError(f"a fold of more than {self.RUN} rows needs merge")
            return found[0]["v"] if found else self.df.sparkSession.range(1).select(first).first()[0]
        return runs.agg(fold(F.collect_list(F.struct("_i", "v")), merge)).first()[0]

    def when_nil(self, value: Any) -> Series:
        return self._new(self.df.select(F.coalesce(self.column, F.lit(value)).alias(self.name)))

    def when(self, mapping: dict) -> Series:
        return self.select(self.expr().when_const(mapping))

    def as_format(self, fmt: str) -> Series:
        return self._new(self.df.select(T.convert(self.column, self.format, fmt).alias(self.name)))

    def sort(self, ascending: bool = True) -> Series:
        return self._new(self.df.orderBy(self.column.asc_nulls_first() if ascending else self.column.desc_nulls_last()))

    def limit(self, offset: int, size: int) -> Series:
        return self._new(self.df.offset(offset).limit(size))

    def distinct(self) -> Series:
        return self._new(self.df.select(self.column).distinct())

    def _fits(self, other: Series) -> DataFrame:
        if self.format != other.format:
            raise FrameError("formats differ")
        return other.df.select(other.column.alias(self.name))

    def append(self, other: Series) -> Series:
        return self._new(self.df.select(self.column).union(self._fits(other)))

    union = append

    def intersection(self, other: Series) -> Series:
        return self._new(self.df.select(self.column).intersect(self._fits(other)))

    def except_(self, other: Series) -> Series:
        return self._new(self.df.select(self.column).subtract(self._fits(other)))

    def join(self, other: Series, how: str = EQUI_JOIN) -> DataFrame:
        """Side by side by position, or every pair (``cross``)."""
        left, right = Frame(self.df.select(self.column.alias("left"))), Frame(other.df.select(other.column.alias("right")))
        return left.join(right, how, by_position=how != CROSS_JOIN).df

    def group(self) -> Grouped:
        return Frame(self.df.select(self.column)).group(self.name)

    def get(self, i: int) -> Any:
        return Frame(self.df.select(self.column)).get_value(i, 0)

    def for_each(self, f: Callable[[Any], None]) -> None:
        for row in self.df.select(self.column).toLocalIterator():
            f(row[0])

    def copy(self) -> Series:
        return Series(self.df, self.name)

    # statistics
    def sum(self) -> float:
        return self.df.agg(F.sum(self.column.cast("double"))).first()[0]

    def min(self) -> Any:
        return self.df.agg(F.min(self.column)).first()[0]

    def max(self) -> Any:
        return self.df.agg(F.max(self.column)).first()[0]

    def mean(self) -> float:
        return self.df.agg(F.avg(self.column)).first()[0]

    def median(self) -> float:
        return self.df.agg(F.median(self.column)).first()[0]

    def count_distinct_values(self) -> DataFrame:
        return self.df.groupBy(self.column).agg(F.count(F.lit(1)).alias("count"))
