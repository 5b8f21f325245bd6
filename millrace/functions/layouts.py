"""Date layouts by reference time (``2006-01-02``) and by percent codes, as Spark patterns."""

from __future__ import annotations

import re

# fixed values: parts of the reference time, longest first, and the patterns they stand for
REFERENCE_PARTS = {
    "January": "MMMM", "Monday": "EEEE", "-07:00": "xxx", "Z07:00": "XXX", "-0700": "xx", "Z0700": "XX", "2006": "yyyy", ".000000": ".SSSSSS", ".000": ".SSS", "002": "DDD", "Jan": "MMM",
    "Mon": "EEE", "MST": "zzz", "01": "MM", "02": "dd", "03": "hh", "04": "mm", "05": "ss", "06": "yy", "15": "HH", "PM": "a", "_2": "d", "1": "M", "2": "d", "3": "h", "4": "m", "5": "s",
}
# fixed values: percent codes that are patterns
PERCENT_CODES = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "j": "DDD", "f": "ss.SSS", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "I": "hh", "p": "a", "%": "%"}

_PART = re.compile("|".join(map(re.escape, sorted(REFERENCE_PARTS, key=len, reverse=True))))


def _quoted(text: str) -> str:
    """Literal text in a pattern: letters and quotes need quotes."""
    return re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", text)


def from_reference(layout: str) -> str:
    """The Spark pattern of a layout written as the reference time."""
    out, at = [], 0
    for m in _PART.finditer(layout):
        out += [_quoted(layout[at : m.start()]), REFERENCE_PARTS[m[0]]]
        at = m.end()
    return "".join(out) + _quoted(layout[at:])


def from_percent(layout: str) -> list[tuple[str, str]]:
    """Parts of a percent layout: ('pattern', p), ('text', t) or ('code', c) for those that no pattern covers (w, W, s, J)."""
    out: list[tuple[str, str]] = []
    for m in re.finditer(r"%(.)|([^%]+|%$)", layout, re.S):
        if m[1] is None:
            out.append(("text", m[2]))
        elif m[1] == "%":
            out.append(("text", "%"))
        elif m[1] in PERCENT_CODES:
            out.append(("pattern", PERCENT_CODES[m[1]]))
        else:
            out.append(("code", m[1]))
    return out
