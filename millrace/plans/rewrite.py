"""Dialect rewriter: turns the accepted SQL dialect into Spark SQL before parsing.

It works on tokens, so literals, comments and quoted names are never touched by accident:

* text that is not a query gets ``select`` in front; unaliased expressions are named by their text;
* ``"name"`` is an identifier if it names something known (or looks like a name), else a string;
* ``MATCH``, ``GLOB``, ``IS``, ``ISNULL``, ``NOTNULL``, ``->``, ``->>``, ``COLLATE NOCASE``;
* functions whose names or argument rules differ (see ``CALLS``);
* set operations associate to the left;
* bare columns of a grouped select; numbers with a fraction are doubles;
* ``GROUPS`` frames and ``EXCLUDE CURRENT ROW`` or ``NO OTHERS`` (of ``ROWS`` frames).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from ..functions.layouts import from_percent

_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\[[A-Za-z_][^\]]*\])"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<op>->>|->|<=>|\|\||<<|>>|<=|>=|<>|!=|==|.)",
    re.S,
)
STARTS = {"select", "with", "values", "describe", "desc", "pragma", "show", "explain"}
_AFTER_EXPR = {"from", "where", "group", "having", "order", "limit", "union", "intersect", "except", "window", "offset"}
_JOIN_WORDS = {"join", "on", "and", "or", "when", "then", "else", "not", "select", "where", "by", "having", "in", "between", "case", "distinct", "like", "is"}


@dataclass
class Tok:
    kind: str
    text: str

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else self.text


def tokenize(sql: str) -> list[Tok]:
    return [Tok(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def literal(text: str) -> str:
    """A Spark string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_of(token: str) -> str:
    """The value of a quoted literal of the dialect, in which backslashes are plain."""
    return token[1:-1].replace("''", "'")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob pattern."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end]
            out.append("[" + ("^" if body[0] in "^!" else "") + body[body[0] in "^!" :].replace("\\", "\\\\").replace("[", "\\[") + "]")
            i = end
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "(?s)^" + "".join(out) + "$"


# ---------------------------------------------------------------- dates
def _moment(args: list[str]) -> tuple[str, list[str]]:
    """The timestamp a date function starts from, and its modifiers' texts."""
    first = args[0] if args else "'now'"
    mods = [text_of(a) if a.startswith("'") else a for a in args[1:]]
    low = [m.strip().lower() for m in mods]
    if first.lower() == "'now'":
        base = "current_timestamp()"
    elif "unixepoch" in low:
        base = f"timestamp_micros(cast(cast({first} as decimal(28,6)) * 1000000 as bigint))"
    elif "julianday" in low:
        base = f"timestamp_micros(cast((({first}) - 2440587.5) * 86400000000 as bigint))"
    else:
        base = f"try_to_timestamp(cast({first} as string))"
    return base, low


def _modified(args: list[str]) -> str:
    at, mods = _moment(args)
    for m in mods:
        if m in ("unixepoch", "julianday", "auto", "utc", "localtime", "subsec"):
            continue
        if got := re.fullmatch(r"start of (year|month|day)", m):
            at = f"date_trunc('{got[1]}', {at})"
        elif got := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(year|month|day|hour|minute|second)s?", m):
            n, unit = got[1], got[2]
            if unit in ("year", "month"):
                # a day past the month's end runs into the next month
                months = int(float(n)) * (12 if unit == "year" else 1)
                at = f"(cast(date_add(add_months(trunc({at}, 'MM'), {months}), dayofmonth({at}) - 1) as timestamp) + ({at} - date_trunc('day', {at})))"
            else:
                at = f"({at} + make_dt_interval({', '.join(n if u == unit else '0' for u in ('day', 'hour', 'minute', 'second'))}))" if "." not in n or unit == "second" else f"timestamp_micros(unix_micros({at}) + cast({n} * {dict(day=86400, hour=3600, minute=60)[unit]}000000 as bigint))"
        elif got := re.fullmatch(r"weekday ([0-6])", m):
            at = f"({at} + make_dt_interval(pmod({got[1]} - (dayofweek({at}) - 1), 7)))"
        else:
            raise ValueError(f"unknown date modifier: {m}")
    return at


def _strftime(args: list[str]) -> str:
    at, out = _modified(args[1:]), []
    codes = {
        "w": f"cast(dayofweek({at}) - 1 as string)", "u": f"cast(weekday({at}) + 1 as string)", "s": f"cast(unix_seconds({at}) as string)", "J": f"cast({_julian(at)} as string)",
        "W": f"lpad(cast(cast((dayofyear({at}) + 6 - weekday({at})) div 7 as int) as string), 2, '0')", "e": f"lpad(cast(dayofmonth({at}) as string), 2)",
    }
    for kind, p in from_percent(text_of(args[0])):
        out.append(literal(p) if kind == "text" else f"date_format({at}, '{p}')" if kind == "pattern" else codes[p])
    return f"concat({', '.join(out)})" if out else "''"


def _julian(at: str) -> str:
    return f"(unix_micros({at}) / 86400000000D + 2440587.5D)"


# ---------------------------------------------------------------- functions
def _path(p: str) -> str:
    """A JSON path of the arrow operators: a name, an index or a full path."""
    if p.startswith("'"):
        inner = text_of(p)
        return literal(inner if inner.startswith("$") else f"$.{inner}")
    return f"concat('$[', {p}, ']')" if not p.isdigit() else f"'$[{p}]'"


def _scalar(name: str) -> Callable[[list[str]], str]:
    best = {"max": "greatest", "min": "least"}[name]

    def call(a: list[str]) -> str:
        if len(a) < 2:
            return f"{name}({', '.join(a)})"
        return f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {best}({', '.join(a)}) END"

    return call


def _group_concat(a: list[str]) -> str:
    first, sep = a[0], a[1] if len(a) > 1 else "','"
    if m := re.match(r"distinct\s+(.*)", first, re.I | re.S):
        return f"string_agg(DISTINCT cast({m[1]} as string), {sep})"
    return f"string_agg(cast({first} as string), {sep})"


def _substr(a: list[str]) -> str:
    """Positions from 1; a start of 0 or before the text takes from what would lie there."""
    s, start = a[0], a[1]
    plain = len(a) == 2 or re.fullmatch(r"\d+", a[2])
    if (plain and re.fullmatch(r"[1-9]\d*", start)) or (len(a) == 2 and re.fullmatch(r"-\d+", start)):
        return f"substring({', '.join(a)})"
    if len(a) == 2:
        return f"millrace_substr({s}, {start}, NULL)"
    return f"millrace_substr({s}, {start}, {a[2]})"


def _json_value(x: str) -> str:
    """JSON text of one value."""
    return f"(CASE WHEN ({x}) IS NULL THEN 'null' ELSE regexp_extract(to_json(array({x})), '(?s)^\\\\[(.*)\\\\]$', 1) END)"


def _json_array(a: list[str]) -> str:
    return "concat('[', concat_ws(',', " + ", ".join(map(_json_value, a)) + "), ']')" if a else "'[]'"


def _json_object(a: list[str]) -> str:
    pairs = [f"concat(millrace_json_name(cast({k} as string)), ':', {_json_value(v)})" for k, v in zip(a[::2], a[1::2], strict=True)]
    return "concat('{', concat_ws(',', " + ", ".join(pairs) + "), '}')" if pairs else "'{}'"


def _approx_count_distinct(a: list[str], tail: str = "") -> str:
    """An estimate whose standard error is 1.6 % (Spark's own has 5 %); ``tail`` is the call's FILTER and OVER.

    The sketch grows with what it has seen, so that beside ``count(DISTINCT)``, which keeps one for each value, it stays
    small. An error the caller gives is Spark's to hold. Collated strings are hashed by the sketch, which knows collations.
    """
    if len(a) > 1:
        return f"approx_count_distinct({', '.join(a)}){tail}"
    x = re.sub(r"(?i)^distinct\b\s*", "", a[0])
    value = x if re.search(r"(?i)\bcollate\b", x) else f"CASE WHEN ({x}) IS NOT NULL THEN xxhash64({x}) END"
    return f"hll_sketch_estimate(hll_sketch_agg({value}, 12){tail})"


CALLS: dict[str, Callable[[list[str]], str]] = {
    "approx_count_distinct": _approx_count_distinct,
    "iif": lambda a: f"if({', '.join(a + ['NULL'] * (3 - len(a)))})",
    "group_concat": _group_concat,
    "total": lambda a: f"coalesce(sum(cast({a[0]} as double)), 0D)",
    "max": _scalar("max"),
    "min": _scalar("min"),
    "log": lambda a: f"log10({a[0]})" if len(a) == 1 else f"log({', '.join(a)})",
    "trunc": lambda a: f"cast({a[0]} as bigint)" if len(a) == 1 else f"trunc({', '.join(a)})",
    "regexp": lambda a: f"({a[1]} RLIKE {a[0]})",
    "match": lambda a: f"contains({a[1]}, {a[0]})",
    "glob": lambda a: f"({a[1]} RLIKE {literal(glob_regex(text_of(a[0])))})" if a[0].startswith("'") else f"({a[1]} RLIKE millrace_glob({a[0]}))",
    "like": lambda a: f"({a[1]} LIKE {a[0]})",
    "trim": lambda a: f"btrim({', '.join(a)})" if len(a) == 2 else f"trim({a[0]})",
    "ltrim": lambda a: f"ltrim({a[1]}, {a[0]})" if len(a) == 2 else f"ltrim({a[0]})",
    "rtrim": lambda a: f"rtrim({a[1]}, {a[0]})" if len(a) == 2 else f"rtrim({a[0]})",
    "substr": _substr,
    "substring": _substr,
    "char": lambda a: "concat(" + ", ".join(f"char({x})" for x in a) + ")",
    "unicode": lambda a: f"ascii({a[0]})",
    "likely": lambda a: a[0],
    "unlikely": lambda a: a[0],
    "likelihood": lambda a: f"({a[0]})",
    "quote": lambda a: f"(CASE WHEN ({a[0]}) IS NULL THEN 'NULL' WHEN typeof({a[0]}) = 'string' THEN concat('\\'', replace(cast({a[0]} as string), '\\'', '\\'\\''), '\\'') ELSE cast({a[0]} as string) END)",
    "typeof": lambda a: f"(CASE WHEN ({a[0]}) IS NULL THEN 'null' ELSE millrace_typeof(typeof({a[0]})) END)",
    "random": lambda a: "cast((rand() - 0.5) * 18446744073709551615 as bigint)",
    "date": lambda a: f"date_format({_modified(a)}, 'yyyy-MM-dd')",
    "time": lambda a: f"date_format({_modified(a)}, 'HH:mm:ss')",
    "datetime": lambda a: f"date_format({_modified(a)}, 'yyyy-MM-dd HH:mm:ss')",
    "julianday": lambda a: _julian(_modified(a)),
    "unixepoch": lambda a: f"unix_seconds({_modified(a)})",
    "strftime": _strftime,
    "json_extract": lambda a: f"get_json_object({a[0]}, {a[1]})" if len(a) == 2 else "concat('[', concat_ws(',', " + ", ".join(f"coalesce(to_json(try_variant_get(try_parse_json({a[0]}), {p}, 'variant')), 'null')" for p in a[1:]) + "), ']')",
    "json_array_length": lambda a: f"json_array_length({a[0] if len(a) == 1 else f'get_json_object({a[0]}, {a[1]})'})",
    "json_valid": lambda a: f"cast(try_parse_json({a[0]}) is not null as int)",
    "json_type": lambda a: f"millrace_json_type({a[0] if len(a) == 1 else f'get_json_object({a[0]}, {a[1]})'})",
    "json_quote": lambda a: _json_value(a[0]),
    "json_array": _json_array,
    "json_object": _json_object,
    "json_group_array": lambda a: f"concat('[', coalesce(string_agg({_json_value(a[0])}, ','), ''), ']')",
    "json_group_object": lambda a: f"concat('{{', coalesce(string_agg(concat(millrace_json_name(cast({a[0]} as string)), ':', {_json_value(a[1])}), ','), ''), '}}')",
    "json": lambda a: f"to_json(parse_json({a[0]}))",
    "format": lambda a: f"printf({', '.join(a)})",
    "zeroblob": lambda a: f"unhex(repeat('00', {a[0]}))",
    "randomblob": lambda a: f"unhex(substring(repeat(sha2(cast(rand() as string), 512), cast(ceil(({a[0]}) / 64) as int)), 1, 2 * ({a[0]})))",
    **{f: (lambda a, f=f: f"millrace_{f}({', '.join(a)})") for f in ("json_patch",)},
    **{f: (lambda a, f=f: f"millrace_json_edit('{f[5:]}', {a[0]}, array({', '.join(a[1:] if f == 'json_remove' else a[1::2])}), array({'' if f == 'json_remove' else ', '.join(map(_json_value, a[2::2]))}))") for f in ("json_set", "json_insert", "json_replace", "json_remove")},
}


class Rewriter:
    def __init__(self, known: set[str] | None = None, compat: str | None = None):
        self.known = None if known is None else {k.lower() for k in known}
        self.compat = compat

    # -- tokens
    def _quoted(self, tok: Tok, aliases: set[str]) -> str:
        body = tok.text[1:-1].replace(tok.text[0] * 2, tok.text[0])
        if tok.text[0] == '"' and self.known is not None and body.lower() not in self.known | aliases:
            return literal(body)
        if tok.text[0] == '"' and self.known is None and not re.fullmatch(r"[\w ]+", body):
            return literal(body)
        return "`" + body.replace("`", "``") + "`"

    def rewrite(self, sql: str) -> str:
        sql = sql.strip().rstrip(";").strip()
        toks = tokenize(sql)
        first = next((t for t in toks if t.kind != "space" and t.text != "("), None)
        if first is None or first.low not in STARTS:
            toks = tokenize("select " + sql)
        aliases = set()
        for i, t in enumerate(toks):
            if t.kind == "word" and t.low == "as":
                nxt = next((x for x in toks[i + 1 :] if x.kind != "space"), None)
                if nxt and nxt.kind == "quoted":
                    aliases.add(nxt.text[1:-1].lower())
        toks = self._frames(self._bare(self._name_columns(toks)))
        out = [Tok("word", self._quoted(t, aliases)) if t.kind == "quoted" else Tok("string", literal(text_of(t.text))) if t.kind == "string" and "\\" in t.text or t.kind == "string" and "''" in t.text[1:-1] else t for t in toks]
        return self._left_assoc(self._walk(out)).strip()

    def _name_columns(self, toks: list[Tok]) -> list[Tok]:
        """Name unaliased expressions of the outermost select list by their text."""
        depth, start = 0, None
        for i, t in enumerate(toks):
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if t.kind == "word" and depth == 0 and t.low == "select":
                start = i + 1
                break
        if start is None:
            return toks
        while start < len(toks) and (toks[start].kind == "space" or toks[start].low in ("distinct", "all")):
            start += 1
        items, item, depth, case, i = [], [], 0, 0, start
        while i < len(toks):
            t = toks[i]
            if t.kind == "op" and t.text in "()":
                depth += 1 if t.text == "(" else -1
            if t.kind == "word":
                case += (t.low == "case") - (t.low == "end")
            if depth == 0 and t.kind == "word" and t.low in _AFTER_EXPR:
                break
            if depth == 0 and t.text == "," and t.kind == "op":
                items.append(item)
                item = []
            else:
                item.append(t)
            i += 1
        items.append(item)
        named = []
        for item in items:
            body = [t for t in item if t.kind != "space"]
            if body and not self._has_name(body):
                text = "".join(t.text for t in item).strip()
                tail = [Tok("space", " ")] if i < len(toks) else []
                item = [*self._stripped(item), Tok("space", " "), Tok("word", "AS"), Tok("space", " "), Tok("quoted", "`" + text.replace("`", "``") + "`"), *tail]
            named.append(item)
        out = toks[:start]
        for k, item in enumerate(named):
            out += ([Tok("op", ",")] if k else []) + item
        return out + toks[i:]

    def _bare(self, toks: list[Tok]) -> list[Tok]:
        """Columns of a grouped select that are neither keys nor aggregated: of the row with the one max() or min(), else of any row."""
        low = lambda t: t.low if t.kind != "quoted" else t.text[1:-1].lower()
        levels, depth = [], 0
        for t in toks:
            depth -= t.kind == "op" and t.text == ")"
            levels.append(depth)
            depth += t.kind == "op" and t.text == "("
        at = {w: next((i for i, t in enumerate(toks) if levels[i] == 0 and t.kind == "word" and t.low == w), None) for w in ("select", "from", "group")}
        if None in at.values() or at["from"] < at["select"] or any(levels[i] == 0 and t.low in ("union", "except", "intersect", "with") for i, t in enumerate(toks) if t.kind == "word"):
            return toks
        end = next((i for i in range(at["group"], len(toks)) if levels[i] == 0 and toks[i].kind == "word" and toks[i].low in ("having", "order", "limit", "window")), len(toks))
        keys, key = [], []
        for i in range(at["group"] + 1, end):
            t = toks[i]
            if levels[i] == 0 and t.kind == "op" and t.text == ",":
                keys, key = [*keys, key], []
            elif t.kind != "space" and not (t.kind == "word" and t.low == "by"):
                key.append(low(t))
        keys = [*keys, key]
        if any(len(k) > 1 and k[0] in ("rollup", "cube", "grouping") or k == ["all"] for k in keys):
            return toks
        names = {k[-1] for k in keys if k}
        first, items, start = at["select"] + 1, [], at["select"] + 1
        for i in range(first, at["from"] + 1):
            if i == at["from"] or levels[i] == 0 and toks[i].kind == "op" and toks[i].text == ",":
                items.append((start, i))
                start = i + 1
        bests, bare = [], []
        for n, (a, b) in enumerate(items):
            body = [i for i in range(a, b) if toks[i].kind != "space"]
            alias = next((k for k, i in enumerate(body) if levels[i] == 0 and toks[i].kind == "word" and toks[i].low == "as"), len(body))
            expr = body[:alias]
            if len(expr) > 3 and toks[expr[0]].low in ("max", "min") and toks[expr[1]].text == "(" and self._close(toks, expr[1]) == expr[-1] and not any(levels[i] == 1 and toks[i].text == "," for i in expr):
                bests.append((toks[expr[0]].low, "".join(t.text for t in toks[expr[1] + 1 : expr[-1]])))
            plain = expr and toks[expr[0]].low != "distinct" and all(toks[i].kind in ("word", "quoted") or toks[i].text == "." for i in expr) and len(expr) in (1, 3)
            given = low(toks[body[alias + 1]]) if alias + 1 < len(body) else None
            if plain and low(toks[expr[-1]]) not in names | {"null", "true", "false"} and given not in names and [str(n + 1)] not in keys:
                bare.append((expr[0], expr[-1]))
        out = list(toks)
        for a, b in reversed(bare):
            column = "".join(t.text for t in toks[a : b + 1])
            text = f"{bests[0][0]}_by({column}, {bests[0][1]})" if len(bests) == 1 else f"any_value({column})"
            tail = [] if any(t.kind == "word" and t.low == "as" for t in toks[b + 1 : next(e for s, e in items if s <= b < e)]) else tokenize(f" AS {toks[b].text}")
            out[a : b + 1] = tokenize(text) + tail
        return out

    def _frames(self, toks: list[Tok]) -> list[Tok]:
        """Window frames Spark lacks: EXCLUDE CURRENT ROW is the frame's two parts, a GROUPS frame a RANGE over the dense rank."""
        ranks: dict[str, str] = {}
        i = 0
        while i < len(toks):
            j = self._next(toks, i + 1)
            if toks[i].kind == "word" and toks[i].low == "over" and j < len(toks) and toks[j].text == "(":
                end = self._close(toks, j)
                words = [(k, toks[k].low) for k in range(j + 1, end) if toks[k].kind == "word"]
                if at := next((k for k, w in words if w == "exclude"), None):
                    rule = [w for k, w in words if k > at]
                    if rule == ["no", "others"]:
                        toks = [*toks[:at], *toks[end:]]
                        continue
                    if rule != ["current", "row"]:
                        raise ValueError(f"EXCLUDE {' '.join(rule).upper()} is not supported")
                    start, text = self._excluding(toks, i, j, at)
                    toks = [*toks[:start], *tokenize(text), *toks[end + 1 :]]
                    continue
                if at := next((k for k, w in words if w == "groups"), None):
                    prefix = "".join(t.text for t in toks[j + 1 : at]).strip()
                    name = ranks.setdefault(prefix, f"_g{len(ranks) + 1}")
                    order = next(k for k, w in words if w == "order")
                    keep = "".join(t.text for t in toks[j + 1 : order])
                    toks = [*toks[: j + 1], *tokenize(f"{keep}ORDER BY {name} RANGE"), *toks[at + 1 :]]
                    continue
            i += 1
        return self._ranked(toks, ranks) if ranks else toks

    @staticmethod
    def _next(toks: list[Tok], i: int) -> int:
        while i < len(toks) and toks[i].kind == "space":
            i += 1
        return i

    def _excluding(self, toks: list[Tok], over: int, opens: int, exclude: int) -> tuple[int, str]:
        """Where the call before OVER starts, and what it is without the current row."""
        close = over - 1
        while toks[close].kind == "space":
            close -= 1
        depth, start = 0, close
        while True:
            depth += (toks[start].text == ")") - (toks[start].text == "(")
            start -= 1
            if depth == 0:
                break
        name, args = toks[start].low, "".join(t.text for t in toks[start + 1 : close + 1])
        rows = next((k for k in range(opens, exclude) if toks[k].low == "rows"), None)
        if rows is None:
            raise ValueError("EXCLUDE CURRENT ROW needs a ROWS frame")
        prefix = "".join(t.text for t in toks[opens + 1 : rows])
        frame = "".join(t.text for t in toks[rows + 1 : exclude]).strip()
        m = re.fullmatch(r"between\s+(.+?)\s+and\s+(.+)", frame, re.I | re.S)
        first, last = (m[1], m[2]) if m else (frame, "CURRENT ROW")
        whole = lambda f, a, b: f"{f}{args} OVER ({prefix}ROWS BETWEEN {a} AND {b})"
        if first.lower().endswith("following") and not first.lower().startswith("unbounded") or last.lower().endswith("preceding"):
            return start, whole(name, first, last)
        sides = [(first, "1 PRECEDING")] * first.lower().endswith("preceding") + [("1 FOLLOWING", last)] * last.lower().endswith("following")
        part = lambda f: [whole(f, a, b) for a, b in sides]
        total = lambda f, none: "(" + " + ".join(f"coalesce({p}, 0)" for p in part(f)) + ")" if sides else none
        if name in ("count", "total"):
            return start, total(name, "0")
        if name == "sum":
            return start, f"(CASE WHEN {total('count', '0')} > 0 THEN {total('sum', '0')} END)"
        if name == "avg":
            return start, f"({total('sum', '0')} / nullif({total('count', '0')}, 0))"
        if name in ("min", "max"):
            found = part(name)
            return start, "NULL" if not found else found[0] if len(found) == 1 else f"coalesce({ {'min': 'least', 'max': 'greatest'}[name] }({', '.join(found)}), {', '.join(found)})"
        raise ValueError(f"{name} with EXCLUDE CURRENT ROW is not supported")

    def _ranked(self, toks: list[Tok], ranks: dict[str, str]) -> list[Tok]:
        """The select over its FROM and WHERE with the dense ranks its frames need."""
        depth, cut = 0, {}
        for k, t in enumerate(toks):
            depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
            if depth == 0 and t.kind == "word" and t.low in ("select", "from", "group", "order", "limit", "union", "except", "intersect"):
                cut.setdefault(t.low, k)
        if not {"select", "from"} <= set(cut) or set(cut) & {"group", "union", "except", "intersect"}:
            raise ValueError("a GROUPS frame needs a plain select")
        if any(t.text == "." and t.kind == "op" for t in toks[: cut["from"]]):
            raise ValueError("a GROUPS frame needs plain column names")
        end = min([cut[w] for w in ("order", "limit") if w in cut and cut[w] > cut["from"]], default=len(toks))
        made = ", ".join(f"dense_rank() OVER ({prefix}) AS {name}" for prefix, name in ranks.items())
        inner = "".join(t.text for t in toks[cut["from"] : end]).strip()
        return [*toks[: cut["from"]], *tokenize(f"FROM (SELECT *, {made} {inner}) "), *toks[end:]]

    @staticmethod
    def _stripped(item: list[Tok]) -> list[Tok]:
        while item and item[-1].kind == "space":
            item = item[:-1]
        return item

    @staticmethod
    def _has_name(body: list[Tok]) -> bool:
        last = body[-1]
        if last.text == "*" and (len(body) == 1 or body[-2].text == "."):
            return True
        if last.kind not in ("word", "quoted"):
            return False
        if len(body) == 1:
            return last.kind == "word" and last.low not in ("null", "true", "false") or last.kind == "quoted"
        before = body[-2]
        if before.text == ".":
            return all(t.kind in ("word", "quoted") or t.text == "." for t in body)
        if before.kind == "word" and before.low == "as":
            return True
        return last.low != "end" and last.low not in ("null", "true", "false", "isnull", "notnull") and (before.kind in ("quoted", "number", "string") or before.text == ")" or before.kind == "word" and before.low not in _JOIN_WORDS | {"match", "glob", "regexp", "collate"})

    def _walk(self, toks: list[Tok]) -> str:
        """Rewrite a token run; parts are kept so that operators can reach their neighbours."""
        parts: list[str] = []
        i = 0
        while i < len(toks):
            t = toks[i]
            if t.kind == "word":
                j = i + 1
                while j < len(toks) and toks[j].kind == "space":
                    j += 1
                opens = j < len(toks) and toks[j].text == "(" and not t.text.startswith("`")
                if opens and (t.low in CALLS or t.low == "json_each" or t.low == "json_tree"):
                    end = self._close(toks, j)
                    args = self._args(toks[j + 1 : end])
                    if t.low in ("json_each", "json_tree"):
                        before = "".join(parts).rstrip().lower()
                        lateral = "" if before.endswith("lateral") or before.endswith("from") else "LATERAL "
                        call = f"{lateral}millrace_{t.low}({', '.join(args if len(args) > 1 else [args[0], 'cast(NULL as string)'])})"
                        nxt = next((x for x in toks[end + 1 :] if x.kind != "space"), None)
                        parts.append(call + ("" if nxt is not None and nxt.kind == "word" and nxt.low not in _AFTER_EXPR | {"join", "on", "left", "inner", "cross"} else f" AS {t.low}"))
                    elif t.low == "approx_count_distinct":
                        end, tail = self._tail(toks, end)
                        parts.append(_approx_count_distinct(args, tail))
                    else:
                        parts.append(CALLS[t.low](args))
                    i = end + 1
                    continue
                handled = self._operator(toks, i, parts)
                if handled is not None:
                    i = handled
                    continue
            if t.kind == "op" and t.text in ("->", "->>"):
                left = self._take_left(parts)
                j, right = self._primary(toks, i + 1)
                path = _path(right.strip())
                parts.append(f"get_json_object({left}, {path})")
                i = j
                continue
            if t.kind == "op" and t.text == "(":
                end = self._close(toks, i)
                parts.append("(" + self._left_assoc(self._walk(self._frames(self._bare(toks[i + 1 : end])) if any(t.low in ("select", "exclude") for t in toks[i + 1 : end]) else toks[i + 1 : end])) + ")")
                i = end + 1
                continue
            # numbers with a fraction are doubles
            fraction = t.kind == "number" and not t.text.isdigit() and not (i + 1 < len(toks) and toks[i + 1].kind == "word")
            parts.append(t.text + "D" if fraction else t.text)
            i += 1
        return "".join(parts)

    def _tail(self, toks: list[Tok], end: int) -> tuple[int, str]:
        """FILTER and OVER after the call that ends there: where they end, and their text."""
        last = end
        for word in ("filter", "over"):
            j = self._next(toks, last + 1)
            k = self._next(toks, j + 1)
            if k < len(toks) and toks[j].kind == "word" and toks[j].low == word and (toks[k].text == "(" or word == "over"):
                last = self._close(toks, k) if toks[k].text == "(" else k
        return last, self._walk(toks[end + 1 : last + 1])

    def _operator(self, toks: list[Tok], i: int, parts: list[str]) -> int | None:
        low = toks[i].low
        j = i + 1
        while j < len(toks) and toks[j].kind == "space":
            j += 1
        nxt = toks[j] if j < len(toks) else Tok("op", "")
        if low in ("match", "glob") and j < len(toks):
            end, right = self._primary(toks, i + 1)
            right = right.strip()
            if low == "glob":
                parts.append(f"RLIKE {literal(glob_regex(text_of(toks[j].text)))}" if toks[j].kind == "string" else f"RLIKE millrace_glob({right})")
            else:
                parts.append(f"contains({self._take_left(parts)}, {literal(text_of(toks[j].text)) if toks[j].kind == 'string' else right})")
            return end
        if low == "is" and nxt.low not in ("null", "true", "false", "unknown", "distinct"):
            if nxt.low == "not":
                k = j + 1
                while k < len(toks) and toks[k].kind == "space":
                    k += 1
                if k < len(toks) and toks[k].low not in ("null", "true", "false", "unknown", "distinct"):
                    parts.append("IS DISTINCT FROM")
                    return j + 1
                return None
            parts.append("IS NOT DISTINCT FROM")
            return i + 1
        if low == "isnull":
            parts.append("IS NULL")
            return i + 1
        if low == "notnull":
            parts.append("IS NOT NULL")
            return i + 1
        if low == "collate" and nxt.low in ("nocase", "binary", "rtrim"):
            parts.append({"nocase": "COLLATE UTF8_LCASE", "binary": "COLLATE UTF8_BINARY", "rtrim": "COLLATE UTF8_BINARY_RTRIM"}[nxt.low])
            return j + 1
        if low == "like" and self.compat == "sqlite":
            parts.append("ILIKE")
            return i + 1
        return None

    @staticmethod
    def _close(toks: list[Tok], i: int) -> int:
        depth = 0
        for k in range(i, len(toks)):
            if toks[k].kind == "op" and toks[k].text in "()":
                depth += 1 if toks[k].text == "(" else -1
                if depth == 0:
                    return k
        raise ValueError("unbalanced parentheses")

    def _args(self, toks: list[Tok]) -> list[str]:
        out, item, depth = [], [], 0
        for t in toks:
            if t.kind == "op" and t.text in "()":
                depth += 1 if t.text == "(" else -1
            if t.text == "," and t.kind == "op" and depth == 0:
                out.append(self._walk(item).strip())
                item = []
            else:
                item.append(t)
        if any(t.kind != "space" for t in item):
            out.append(self._walk(item).strip())
        return out

    def _primary(self, toks: list[Tok], i: int) -> tuple[int, str]:
        """A literal, name chain, call or parenthesis that starts at i, rewritten."""
        while i < len(toks) and toks[i].kind == "space":
            i += 1
        j = i + 1
        if toks[i].text == "(" and toks[i].kind == "op":
            j = self._close(toks, i) + 1
        elif toks[i].kind in ("word", "quoted"):
            while j + 1 < len(toks) and toks[j].text == ".":
                j += 2
            if j < len(toks) and toks[j].text == "(":
                j = self._close(toks, j) + 1
        return j, self._walk(toks[i:j])

    @staticmethod
    def _take_left(parts: list[str]) -> str:
        """The operand before an operator: a name chain, a literal, a call or a parenthesis."""
        while parts and not parts[-1].strip():
            parts.pop()
        out = [parts.pop()]
        if out[0].startswith("(") and parts and re.fullmatch(r"[\w`]+", parts[-1]) and parts[-1].lower() not in _JOIN_WORDS:
            out.insert(0, parts.pop())
        while len(parts) > 1 and parts[-1] == ".":
            out.insert(0, parts.pop())
            out.insert(0, parts.pop())
        return "".join(out)

    @staticmethod
    def _left_assoc(sql: str) -> str:
        """Wrap what comes before an INTERSECT that follows another set operation."""
        depth, seen, head, cuts = 0, False, 0, []
        for m in re.finditer(r"'(?:[^'\\]|\\.)*'|`[^`]*`|[()]|\b(?:union|except|intersect|select|values)\b", sql, re.I):
            word = m[0].lower()
            if word in "()":
                depth += 1 if word == "(" else -1
            elif depth == 0 and word in ("union", "except"):
                seen = True
            elif depth == 0 and word == "intersect" and seen:
                cuts.append(m.start())
            elif depth == 0 and word in ("select", "values") and head == 0 and not seen:
                head = m.start() or 0
        if not cuts:
            return sql
        for shift, cut in enumerate(cuts):
            cut += 2 * shift
            sql = sql[:head] + "(" + sql[head:cut].rstrip() + ") " + sql[cut:] if not sql[head:cut].endswith(" ") else sql[:head] + "(" + sql[head : cut - 1] + ") " + sql[cut:]
        return sql


# ---------------------------------------------------------------- self-joins
@dataclass
class SelfJoin:
    """``FROM table left JOIN table right ON left.key = right.key [AND ...]``, and the edits that block it once views are named."""

    table: str
    key: str
    edits: Callable[[str, str, str, str], list[tuple[int, int, str]]]


def self_joins(toks: list[Tok], columns: Mapping[str, list[str]]) -> list[SelfJoin]:
    """Inner joins of a table (of ``columns``, by lower-case name) with itself on one column, at any depth.

    They must be the whole FROM; queries with WITH are left out, as their names may hide tables.
    """
    real = [i for i, t in enumerate(toks) if t.kind != "space"]
    if any(toks[i].low == "with" for i in real):
        return []
    name = lambda t: t.text[1:-1].lower() if t.kind == "quoted" else t.low if t.kind == "word" else None
    ends = _AFTER_EXPR - {"from"}
    found = []
    for n, i in enumerate(real):
        if toks[i].low != "from":
            continue
        at, sides = n + 1, []
        for stop in (("inner", "join"), ("on",)):
            if at + 1 >= len(real) or name(toks[real[at]]) not in columns:
                break
            table, alias, first = name(toks[real[at]]), toks[real[at]], at
            at += 1
            at += toks[real[at]].low == "as"
            if at < len(real) and toks[real[at]].kind in ("word", "quoted") and toks[real[at]].low not in stop:
                alias = toks[real[at]]
                at += 1
            sides.append((table, alias, real[first], real[at - 1] + 1))
            at += at < len(real) and toks[real[at]].low == "inner"
            if at >= len(real) or toks[real[at]].low != stop[-1]:
                break
            at += 1
        else:
            start, depth, end, words, parts = at, 0, at, set(), [[]]
            while end < len(real):
                t = toks[real[end]]
                depth += (t.text == "(") - (t.text == ")") if t.kind == "op" else 0
                if depth < 0 or depth == 0 and t.kind == "word" and t.low in ends:
                    break
                if depth == 0 and t.kind in ("word", "op"):
                    words.add(t.low)
                parts = [*parts, []] if depth == 0 and t.low == "and" else [*parts[:-1], [*parts[-1], t]]
                end += 1
            (table, left, a, b), (other, right, c, d) = sides
            key = None
            for x in parts:
                if len(x) == 7 and x[1].text == x[5].text == "." and x[3].text in ("=", "==") and {name(x[0]), name(x[4])} == {name(left), name(right)} and name(x[2]) == name(x[6]):
                    key = key or next((k for k in columns[table] if k.lower() == name(x[2])), None)
            stars = _stars(toks, real, n)
            if table != other or name(left) == name(right) or key is None or end == start or stars is None:
                continue
            if words & {"or", "not", "case", "between", "join", "left", "right", "full", "cross", "natural", "lateral", ","}:
                continue

            def edits(view_left, view_right, on_left, on_right, spans=(a, b, c, d, real[start], real[end - 1] + 1), names=(left, right), stars=stars, of=columns[table]):
                a, b, c, d, start, end = spans
                on = "".join(t.text for t in toks[start:end])
                same = " AND ".join(f"{names[0].text}.`{x}` = {names[1].text}.`{x}`" for x in (on_left, on_right))
                every = lambda side: ", ".join(f"{side.text}.`{c.replace('`', '``')}`" for c in of)
                lists = [(s, e, ", ".join(every(x) for x in names if side in (None, name(x)))) for s, e, side in stars]
                return [(a, b, f"`{view_left}` AS {names[0].text}"), (c, d, f"`{view_right}` AS {names[1].text}"), (start, end, f"{on} AND {same}"), *lists]

            found.append(SelfJoin(table, key, edits))
    return found


def _stars(toks: list[Tok], real: list[int], n: int) -> list[tuple[int, int, str | None]] | None:
    """The stars of the select list that ends before this FROM: their spans, and the table they are of. None: not a plain list."""
    out, depth = [], 0
    for m in range(n - 1, -1, -1):
        t = toks[real[m]]
        depth += (t.text == ")") - (t.text == "(") if t.kind == "op" else 0
        if depth < 0:
            return None
        if depth == 0 and t.kind == "word" and t.low == "select":
            return out
        if t.kind == "op" and t.text == "*":
            before = toks[real[m - 1]]
            if before.text == ".":
                if depth:
                    return None
                side = toks[real[m - 2]]
                out.append((real[m - 2], real[m] + 1, side.text.lower().strip('"`[]')))
            elif depth == 0 and (before.text == "," or before.low in ("select", "distinct", "all")):
                out.append((real[m], real[m] + 1, None))
    return None


def rewrite(sql: str, known: set[str] | None = None, compat: str | None = None) -> str:
    """Spark SQL for a query of the dialect. ``known``: names of tables and columns."""
    return Rewriter(known, compat).rewrite(sql)
