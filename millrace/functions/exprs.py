"""Typed expression builders: chains of maps, filters and reductions over one value, as Columns.

A chain starts at a root (the series it is applied to), a named column, or a constant. Its
filters use two-valued logic: a null operand makes a comparison false, except where two values
are compared by equality, which treats nulls as values. Nothing runs in Python: ``value``,
``predicate`` and ``aggregate`` give Column expressions for select, where and agg.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import types as T
from .layouts import from_reference

LEFT, RIGHT, BOTH, NEITHER = "left", "right", "both", "neither"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Expr:
    """A chain; immutable. ``steps``: (kind, function of the value so far)."""

    format = T.STRING

    def __init__(self, start: Callable[[Column | None], Column], steps: tuple = (), alias: str | None = None, name: str | None = None):
        self._start, self._steps, self._alias, self._name = start, steps, alias, name

    @classmethod
    def root(cls) -> Expr:
        def own(c: Column | None) -> Column:
            if c is None:
                raise ValueError("a root expression needs a series")
            return c

        return cls(own)

    @classmethod
    def col(cls, name: str) -> Expr:
        return cls(lambda _: F.col(f"`{name}`"), name=name)

    @classmethod
    def const(cls, value: Any) -> Expr:
        return cls(lambda _: F.lit(value).cast(T.SPARK_TYPES[cls.format]))

    def _step(self, kind: str, f: Callable, fmt: str | None = None) -> Expr:
        return BUILDERS[fmt or self.format](self._start, (*self._steps, (kind, f)), self._alias, self._name)

    def _map(self, f: Callable, fmt: str | None = None) -> Expr:
        return self._step("map", f, fmt)

    def _filter(self, f: Callable) -> Expr:
        return self._step("filter", f)

    @staticmethod
    def _arg(x: Any, own: Column | None) -> Column:
        return x.value(own) if isinstance(x, Expr) else F.lit(x)

    def alias(self, name: str) -> Expr:
        return type(self)(self._start, self._steps, name, self._name)

    def kind(self) -> str:
        return self._steps[-1][0] if self._steps else "map"

    def value(self, own: Column | None = None) -> Column:
        """The mapped value; filters pass it through."""
        c = self._start(own)
        for kind, f in self._steps:
            if kind == "map":
                c = f(c, own)
        return c.alias(self._alias) if self._alias else c

    def predicate(self, own: Column | None = None, rows: bool = False) -> Column | None:
        """All filters of the chain, each on the value at its place; None without filters.

        Two-valued, unless ``rows`` says that it only filters rows, where null is as good as false
        and the bare comparisons reach the scan.
        """
        c, out = self._start(own), None
        for kind, f in self._steps:
            if kind == "map":
                c = f(c, own)
            elif kind == "filter":
                p = f(c, own) if rows else _false(f(c, own))
                out = p if out is None else out & p
        return out

    def aggregate(self, own: Column | None = None) -> Column:
        c = self._start(own)
        for _, f in self._steps:
            c = f(c, own)
        return c.alias(self._alias) if self._alias else c

    # operations of the caller's own, as functions of columns; arguments are values or expressions
    def map_op(self, f: Callable[..., Column], *args: Any, fmt: str | None = None) -> Expr:
        return self._map(lambda c, own: f(c, *[self._arg(a, own) for a in args]), fmt and T.get_format(fmt))

    def filter_op(self, f: Callable[..., Column], *args: Any) -> Expr:
        return self._filter(lambda c, own: f(c, *[self._arg(a, own) for a in args]))

    def reduce_op(self, f: Callable[..., Column], *args: Any, fmt: str | None = None) -> Expr:
        """``f`` makes an aggregate of the value, such as ``F.sum`` or a composition of aggregates."""
        return self._step("reduce", lambda c, own: f(c, *[self._arg(a, own) for a in args]), fmt and T.get_format(fmt))

    # on every format
    def as_format(self, fmt: str, strict: bool = True) -> Expr:
        target = T.get_format(fmt)
        return self._map(lambda c, _: T.convert(c, self.format, target, strict), target)

    def non_nil(self) -> Expr:
        return self._filter(lambda c, _: c.isNotNull())

    def when_nil(self, other: Any) -> Expr:
        return self._map(lambda c, own: F.coalesce(c, self._arg(other, own)))

    def when_const(self, mapping: dict) -> Expr:
        def replaced(c: Column, _) -> Column:
            out = None
            for k, v in mapping.items():
                out = (F if out is None else out).when(c == F.lit(k), F.lit(v))
            return c if out is None else out.otherwise(c)

        return self._map(replaced)

    def eq(self, other: Any) -> Expr:
        return self._filter(lambda c, own: c.eqNullSafe(self._arg(other, own)))

    def ne(self, other: Any) -> Expr:
        return self._filter(lambda c, own: ~c.eqNullSafe(self._arg(other, own)))

    def eq_const(self, value: Any) -> Expr:
        return self._filter(lambda c, _: c == F.lit(value))

    def ne_const(self, value: Any) -> Expr:
        return self.ne(value)

    def in_const(self, *values: Any) -> Expr:
        return self._filter(lambda c, _: c.isin(*values))

    def not_in_const(self, *values: Any) -> Expr:
        return self._filter(lambda c, _: ~c.isin(*values))


class _Ordered(Expr):
    def lt(self, x: Any) -> Expr:
        return self._filter(lambda c, own: c < self._arg(x, own))

    def gt(self, x: Any) -> Expr:
        return self._filter(lambda c, own: c > self._arg(x, own))

    def le(self, x: Any) -> Expr:
        return self._filter(lambda c, own: c <= self._arg(x, own))

    def ge(self, x: Any) -> Expr:
        return self._filter(lambda c, own: c >= self._arg(x, own))

    lt_const, gt_const, le_const, ge_const = lt, gt, le, ge

    def between(self, low: Any, high: Any, include: str = BOTH) -> Expr:
        """``include`` names the ends that belong: left, right, both, neither."""

        def inside(c: Column, own) -> Column:
            a, b = self._arg(low, own), self._arg(high, own)
            return (c >= a if include in (LEFT, BOTH) else c > a) & (c <= b if include in (RIGHT, BOTH) else c < b)

        return self._filter(inside)

    between_const = between


class _Number(_Ordered):
    def op(self, sign: str, x: Any) -> Expr:
        def apply(c: Column, own) -> Column:
            b = self._arg(x, own)
            if sign == "/":
                q = F.try_divide(c, b)
                return q if self.format == T.DOUBLE else F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("long")
            return {"+": c + b, "-": c - b, "*": c * b}[sign]

        return self._map(apply)

    op_const = op

    def agg_sum(self) -> Expr:
        return self._step("reduce", lambda c, _: F.sum(c))

    def agg_min(self) -> Expr:
        return self._step("reduce", lambda c, _: F.min(c))

    def agg_max(self) -> Expr:
        return self._step("reduce", lambda c, _: F.max(c))

    def agg_mean(self) -> Expr:
        return self._step("reduce", lambda c, _: F.avg(c), T.DOUBLE)


class IntExpr(_Number):
    format = T.INTEGER


class DoubleExpr(_Number):
    format = T.DOUBLE


class BoolExpr(Expr):
    """A null operand of and, or, not makes it false."""

    format = T.BOOLEAN

    def and_(self, x: Any) -> Expr:
        return self._map(lambda c, own: _false(c) & _false(self._arg(x, own)) & c.isNotNull() & self._arg(x, own).isNotNull())

    def or_(self, x: Any) -> Expr:
        return self._map(lambda c, own: _false(c | self._arg(x, own)) & c.isNotNull() & self._arg(x, own).isNotNull())

    def not_(self) -> Expr:
        return self._map(lambda c, _: _false(~c))


class StringExpr(Expr):
    """Equality with a null is false, of either sense."""

    format = T.STRING
    _CUT = " \t\f\v"

    def eq(self, other: Any) -> Expr:
        return self._filter(lambda c, own: c == self._arg(other, own))

    def ne(self, other: Any) -> Expr:
        return self._filter(lambda c, own: c != self._arg(other, own))

    def contains(self, x: Any) -> Expr:
        return self._filter(lambda c, own: F.contains(c, self._arg(x, own)))

    def starts_with(self, x: Any) -> Expr:
        return self._filter(lambda c, own: F.startswith(c, self._arg(x, own)))

    def ends_with(self, x: Any) -> Expr:
        return self._filter(lambda c, own: F.endswith(c, self._arg(x, own)))

    def concat(self, sep: str, *others: Any) -> Expr:
        """Self and the others joined by ``sep``; nulls are empty; unchanged without others."""
        if not others:
            return self
        return self._map(lambda c, own: F.concat_ws(sep, *[F.coalesce(x, F.lit("")) for x in (c, *(self._arg(o, own) for o in others))]))

    def substring(self, start: int, end: int) -> Expr:
        """Characters from ``start`` up to but without ``end``, from 0."""
        if start > end:
            raise ValueError("start lies after end")
        return self._map(lambda c, _: F.substring(c, start + 1, end - start))

    def upper(self) -> Expr:
        return self._map(lambda c, _: F.upper(c))

    def lower(self) -> Expr:
        return self._map(lambda c, _: F.lower(c))

    def title(self) -> Expr:
        """The first letter of each word in upper case, the rest as it is."""
        up = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
        return self._map(lambda c, _: F.array_join(F.transform(F.split(c, " "), up), " "))

    def replace_all(self, match: str, by: str) -> Expr:
        return self._map(lambda c, _: F.replace(c, F.lit(match), F.lit(by)))

    def replace(self, match: str, by: str, n: int = -1) -> Expr:
        """The first ``n`` occurrences, all if n is negative."""
        if n < 0:
            return self.replace_all(match, by)

        def first(c: Column, _) -> Column:
            parts = F.split(c, "\\Q" + match + "\\E", n + 1)
            return F.array_join(parts, by) if n else c

        return self._map(first)

    def trim(self) -> Expr:
        return self._map(lambda c, _: F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))

    def ltrim(self) -> Expr:
        return self._map(lambda c, _: F.ltrim(c, F.lit(self._CUT)))

    def rtrim(self) -> Expr:
        return self._map(lambda c, _: F.rtrim(c, F.lit(self._CUT)))

    def split(self, sep: str, i: int) -> Expr:
        """Part ``i`` from 0; null past the last."""
        return self._map(lambda c, _: F.get(F.split(c, "\\Q" + sep + "\\E"), F.lit(i)))

    def extract(self, pattern: str) -> Expr:
        return self._map(lambda c, _: F.regexp_extract(c, pattern, 0))

    def repeat(self, n: int) -> Expr:
        return self._map(lambda c, _: F.repeat(c, n))

    def trim_suffix(self, x: str) -> Expr:
        return self._map(lambda c, _: F.when(c.endswith(x), F.left(c, F.length(c) - len(x))).otherwise(c) if x else c)

    def trim_prefix(self, x: str) -> Expr:
        return self._map(lambda c, _: F.when(c.startswith(x), F.substring(c, len(x) + 1, 1 << 30)).otherwise(c) if x else c)

    def parse_datetime(self, layout: str) -> Expr:
        """By reference-time layout; null where it does not fit."""
        return self._map(lambda c, _: F.try_to_timestamp(c, F.lit(from_reference(layout))), T.DATETIME)

    def len(self) -> Expr:
        """Length in bytes; null is 0."""
        return self._map(lambda c, _: F.coalesce(F.octet_length(c), F.lit(0)).cast("long"), T.INTEGER)


class DatetimeExpr(_Ordered):
    format = T.DATETIME

    def _part(self, f: Callable) -> Expr:
        return self._map(lambda c, _: f(c).cast("long"), T.INTEGER)

    def year(self) -> Expr:
        return self._part(F.year)

    def month(self) -> Expr:
        return self._part(F.month)

    def day(self) -> Expr:
        return self._part(F.dayofmonth)

    def hour(self) -> Expr:
        return self._part(F.hour)

    def minute(self) -> Expr:
        return self._part(F.minute)

    def second(self) -> Expr:
        return self._part(F.second)

    def unix_milli(self) -> Expr:
        return self._part(lambda c: F.unix_millis(c.cast("timestamp")))

    def add_date(self, years: Any = 0, months: Any = 0, days: Any = 0) -> Expr:
        """Calendar arithmetic in which a day past the month's end runs into the next."""

        def added(c: Column, own) -> Column:
            y, m, d = (F.coalesce(self._arg(x, own), F.lit(0)).cast("int") for x in (years, months, days))
            first = F.add_months(F.trunc(c, "month"), y * 12 + m)
            day = F.date_add(first, F.dayofmonth(c) - 1 + d)
            t = c.cast("timestamp")
            return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + F.unix_micros(t) - F.unix_micros(F.date_trunc("day", t)))

        return self._map(added)

    def add_time(self, hours: Any = 0, minutes: Any = 0, seconds: Any = 0) -> Expr:
        def added(c: Column, own) -> Column:
            h, m, s = (F.coalesce(self._arg(x, own), F.lit(0)) for x in (hours, minutes, seconds))
            return c + F.make_dt_interval(F.lit(0), h.cast("int"), m.cast("int"), s.cast("decimal(18,6)"))

        return self._map(added)

    def format_as(self, layout: str) -> Expr:
        return self._map(lambda c, _: F.date_format(c, from_reference(layout)), T.STRING)


BUILDERS: dict[str, type[Expr]] = {T.INTEGER: IntExpr, T.DOUBLE: DoubleExpr, T.STRING: StringExpr, T.BOOLEAN: BoolExpr, T.DATETIME: DatetimeExpr}
