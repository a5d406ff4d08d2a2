"""Regular expressions as the checks mean them, for Spark and for SQL engines with RE2.

The checks are stated with ASCII word boundaries, Unicode white space and an end
anchor that means the very end.  Java reads all three otherwise, so patterns go
through :func:`spark`; RE2 reads boundaries and anchors as meant.
"""

from __future__ import annotations

import re
from re import _parser

#: What counts as white space.
#: Java asks the parts of a class in turn: most characters are told by the first one and the bounds of the second.
SPACE = r"\t-\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]"
#: The same as characters.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_WORD = "A-Za-z0-9_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
#: A boundary beside an ASCII word character has one side only.
_BEGIN, _END = f"(?<![{_WORD}])", f"(?![{_WORD}])"


def _edge(pattern: str, at: int) -> str:
    """The boundary at place ``at``: one look-around where a plain word character stands right beside it."""
    after, before = pattern[at + 2 : at + 3], pattern[at - 1 : at] if at else ""
    quantified = pattern[at + 3 : at + 4] in ("?", "*", "{")
    if re.match(r"[A-Za-z0-9]", after) and not quantified:
        return _BEGIN
    escaped = at > 1 and pattern[at - 2] == "\\"
    if re.match(r"[A-Za-z0-9]", before) and not escaped:
        return _END
    return _EDGE


def spark(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` for Java: boundaries, white space and the end anchor spelled out."""
    out, in_class, i = ["(?i)"] if ignore_case else [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            plain = {"b": _edge(pattern, i), "s": f"[{SPACE}]", "S": f"[^{SPACE}]"}
            inside = {"s": SPACE, "S": f"&&[^{SPACE}]"}
            out.append((inside if in_class else plain).get(n, c + n))
            i += 2
            continue
        if in_class and c == "[":
            out.append("\\[")
        elif c == "$" and not in_class:
            out.append(r"\z")
        else:
            in_class = (c == "[") or (in_class and c != "]")
            out.append(c)
        i += 1
    return "".join(out)


def needles(pattern: str) -> list[str] | None:
    """Lower-case strings of which every match of ``pattern`` holds one, in any case of letters; None if none are known."""
    try:
        return _needles(list(_parser.parse(pattern)))
    except re.error:  # a pattern of another dialect is tested as it is
        return None


def _needles(items: list) -> list[str] | None:
    best, run = None, ""

    def better(found: list[str] | None) -> list[str] | None:
        long = lambda x: min(map(len, x)) if x else 0
        return found if long(found) > max(long(best), 1) else best

    for op, arg in items:
        if op is _parser.LITERAL and chr(arg).isascii():
            run += chr(arg).lower()
            continue
        best, run = better([run]), ""
        if op is _parser.SUBPATTERN:
            best = better(_needles(list(arg[-1])))
        elif op is _parser.BRANCH:
            each = [_needles(list(b)) for b in arg[1]]
            best = better([n for some in each for n in some] if all(each) else None)
        elif op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT) and arg[0]:
            best = better(_needles(list(arg[2])))
    return better([run])


def whole_word(phrase: str) -> str:
    return rf"\b{re.escape(phrase)}\b"


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
