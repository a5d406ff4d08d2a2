"""Scalars over text that built-in functions express, and the few that need Arrow UDFs."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from lectern.functions.patterns import SPACE, SPACES, spark


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"[{SPACE}]+", " "))


def without_code(c: Column) -> Column:
    """Inline code replaced by one space."""
    return F.regexp_replace(c, "`[^`]*`", " ")


def prose(c: Column) -> Column:
    """Inline code replaced and link targets cut."""
    return F.regexp_replace(without_code(c), spark(r"\]\([^)\s]*"), "](")


def slug(c: Column) -> Column:
    """Anchor of a heading: markup unwrapped, punctuation dropped, a hyphen per white-space character."""
    s = F.lower(strip(c))
    for pattern in (r"`([^`]*)`", r"\*\*([^*]*)\*\*", r"\*([^*]*)\*", r"\[([^\]]*)\]\([^)]*\)"):
        s = F.regexp_replace(s, pattern, "$1")
    s = F.regexp_replace(s, f"[^A-Za-z0-9_{SPACE}-]", "")
    return F.regexp_replace(s, f"[{SPACE}]", "-")


def slug_escaped(c: Column) -> Column:
    s = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return slug(s)


def shingle_words(c: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(c), f"[^a-z0-9{SPACE}]", " "), f"[{SPACE}]+"), "")


def shingles(c: Column, n: int) -> Column:
    """Distinct n-word windows of lower-cased text; none if there are fewer words."""
    return F.transform(F.array(shingle_words(c)), lambda w: F.when(
        F.size(w) >= n,
        F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat(*[x for k in range(n) for x in (F.lit(" "), F.get(w, i + k))][1:]))),
    ).otherwise(F.array().cast("array<string>")))[0]


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(part: Column, whole: Column) -> Column:
    return F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part))


def sentences(c: Column) -> Column:
    """Split after . ? ! before a capital, backtick, quote or parenthesis; blanks dropped."""
    parts = F.split(c, f"(?<=[.?!])[{SPACE}]+(?=[A-Z`\"'(])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def readable(c: Column) -> Column:
    """A line without its list marker, links reduced to labels, code to CODE."""
    s = F.regexp_replace(c, spark(r"^\s*(?:[-*+]|\d+\.)\s+"), "")
    return F.regexp_replace(F.regexp_replace(s, r"\[([^\]]*)\]\([^)]*\)", "$1"), "`[^`]*`", " CODE ")


def word_count(c: Column) -> Column:
    return F.size(F.array_remove(F.split(c, f"[{SPACE}]+"), ""))


def cells(c: Column) -> Column:
    """Cells of a table row by plain split, one outer pipe dropped on each side."""
    s = strip(c)
    s = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(s, r"\|"), strip)


# ---- same-length masks: all spans are found on the original line ------------------

#: Spans that are not prose.
_ENTITY = re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7}|#[xX][0-9a-fA-F]{1,6});", re.A)
_CODE = re.compile(r"`[^`]*`")
_TAG = re.compile(r"<[^>]+>")
_TARGET = re.compile(r"\]\([^)]*\)")
_ATTRIBUTES = re.compile(r'^\s*(?:[a-zA-Z-]+\s*=\s*"[^"]*"\s*)+/?>?\s*\Z')
_URL = re.compile(r"""https?://[^\s`<>"']+""")
_URL_END = re.compile(r"[.,;:!?)\]}]+\Z")
_SAID = re.compile(r'(?<![A-Za-z0-9_])(?:alt|title|aria-label|placeholder)\s*=\s*"([^"]*)"', re.I)
_TRIGGER = re.compile(r"[&`<>=]|\]\(|https?:")


def masked(line: str, fill: str = " ", said: bool = True) -> str:
    """``line`` with protected spans overwritten by ``fill``, length kept.

    With ``said``, the values of attributes that readers see stay open, entities
    in them excepted.
    """
    if not _TRIGGER.search(line):
        return line
    hidden = bytearray(len(line))

    def cover(start: int, stop: int, on: int = 1) -> None:
        hidden[start:stop] = bytes([on]) * (stop - start)

    for span in (_ENTITY, _CODE, _TAG, _TARGET, _ATTRIBUTES):
        for m in span.finditer(line):
            cover(*m.span())
    for m in _URL.finditer(line):
        tail = _URL_END.search(m[0])
        cover(m.start(), m.end() - (len(tail[0]) if tail else 0))
    if said:
        for m in _SAID.finditer(line):
            at = m.start() + m[0].find(m[1])
            cover(at, at + len(m[1]), 0)
            for e in _ENTITY.finditer(m[1]):
                cover(at + e.start(), at + e.end())
    return "".join(fill if h else c for c, h in zip(line, hidden, strict=True))


@F.pandas_udf(StringType())
def prose_mask(lines: pd.Series) -> pd.Series:
    return lines.map(masked, na_action="ignore")


@F.pandas_udf(StringType())
def emphasis_mask(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: masked(s, "x"), na_action="ignore")


# ---- table rows -------------------------------------------------------------------

_ROW = re.compile(r"^\s*\|")
_RULE = re.compile(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*\Z")
_LINK = re.compile(r"!?\[[^\]]*\]\([^)]*\)")
_COMMENT = re.compile(r"\s*<!--[\s\S]*?-->\s*\Z")


def cell_spans(line: str) -> list[tuple[int, int]]:
    """Spans of a row's cells; pipes in code, tags or behind a backslash do not separate."""
    open_line = masked(line, " ", said=False)
    bars = [i for i, c in enumerate(open_line) if c == "|" and line[i] == "|" and (i == 0 or line[i - 1] != "\\")]
    if not bars:
        return [(0, len(line))]
    tail = _COMMENT.search(line)
    end = tail.start() if tail else len(line)
    edges = [-1, *(b for b in bars if b < end), end]
    spans = [(a + 1, b) for a, b in zip(edges, edges[1:], strict=False)]
    if spans and not line[slice(*spans[0])].strip():
        spans = spans[1:]
    if spans and not line[slice(*spans[-1])].strip():
        spans = spans[:-1]
    return spans


def row_faults(line: str) -> list[int]:
    """Cell numbers, one for each broken pair (bold, parentheses, brackets) of a table row."""
    if not _ROW.search(line) or _RULE.search(line):
        return []
    shape = masked(_LINK.sub(lambda m: " " * len(m[0]), line), " ", said=False)
    found = []
    for n, (a, b) in enumerate(cell_spans(line), 1):
        cell = shape[a:b]
        found += [n] * (cell.count("**") % 2 == 1)
        found += [n] * (cell.count("(") != cell.count(")"))
        found += [n] * (cell.count("[") != cell.count("]"))
    return found


@F.pandas_udf(ArrayType(StringType()))
def real_cells(lines: pd.Series) -> pd.Series:
    return lines.map(lambda s: [s[a:b].strip() for a, b in cell_spans(s)], na_action="ignore")


@F.pandas_udf(ArrayType(IntegerType()))
def broken_cells(lines: pd.Series) -> pd.Series:
    return lines.map(row_faults, na_action="ignore")


# ---- status codes -----------------------------------------------------------------

#: Wording around a number that makes it a status code, or something else.
_STATUS = re.compile(r"(?<![A-Za-z0-9_.:/-])[1-5][0-9]{2}(?![A-Za-z0-9_%]|[.,]\d)")
_BEFORE = re.compile(
    r"\b(?:HTTP|status(?: code)?|code|error|errors|returns?|returned|returning|responds? with|responded with|response|"
    r"fails? with|failed with|gets?|got)\s+(?:an?\s+|the\s+|code\s+)?\Z", re.I | re.A)
_AFTER = re.compile(
    r"^\s*(?:/\s*[1-5][0-9]{2}\s*)?(?:errors?|responses?|status|codes?|OK\b|Created|Accepted|No Content|Moved|Found|Not Modified|"
    r"Bad Request|Unauthorized|Payment Required|Forbidden|Not Found|Method Not Allowed|Conflict|Gone|Unprocessable|Too Many Requests|"
    r"Internal Server Error|Bad Gateway|Service Unavailable|Gateway Timeout)\b", re.A)
_AMOUNT = re.compile(
    r"\b(?:up to|at most|at least|limit of|maximum of|max(?:imum)?|minimum of|more than|fewer than|less than|over|under|of|than|"
    r"first|last|top|every|each)\s+\Z", re.I | re.A)
_UNIT = re.compile(
    r"^\s*(?:[a-z]+s\b|ms\b|s\b|sec|min|KB|MB|GB|TB|px|%|characters?|chars?|words?|lines?|items?|rows?|tools?|profiles?|entries|"
    r"requests?|calls?|users?|members?|seconds?|minutes?|hours?|days?)", re.I | re.A)
_JOINED = re.compile(r"\b[1-5][0-9]{2}\s*(?:/|,|or|and)\s*\Z", re.A)


def status_codes(line: str) -> list[str]:
    bare = _CODE.sub(lambda m: " " * len(m[0]), line)
    found: list[str] = []
    for m in _STATUS.finditer(bare):
        before, after = bare[max(0, m.start() - 40) : m.start()], bare[m.end() : m.end() + 40]
        joined = bool(found) and bool(_JOINED.search(before))
        named = bool(_BEFORE.search(before)) or joined
        amount = bool(_AMOUNT.search(before))
        if amount or (_UNIT.search(after) and not named):
            continue
        if named or _AFTER.search(after):
            found.append(m[0])
    return list(dict.fromkeys(found))


@F.pandas_udf(ArrayType(StringType()))
def status_codes_in(lines: pd.Series) -> pd.Series:
    return lines.map(status_codes, na_action="ignore")


# ---- word distance -----------------------------------------------------------------


def word_distance(a: str, b: str, budget: int) -> bool:
    """Whether more than ``budget`` word insertions, deletions and changes part ``a`` from ``b``."""
    x, y = a.split(), b.split()
    if abs(len(x) - len(y)) > budget:
        return True
    row = list(range(len(y) + 1))
    for i, u in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (u != v))
        if min(row) > budget:
            return True
    return row[-1] > budget


@F.pandas_udf(BooleanType())
def over_budget(a: pd.Series, b: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([word_distance(x or "", y or "", int(n)) for x, y, n in zip(a, b, budget, strict=True)])
