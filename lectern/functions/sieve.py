"""Sieves: which lines may match a pattern, told for many patterns in one pass.

A sieve lets every line through that its check could report and most others not;
the check's own pattern then decides.  RE2 reads a line once for a pattern however
many words it lists, so all sieves take less than one of the checks' own patterns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: White space as ``patterns.SPACE`` has it, and what RE2 folds to ASCII letters but Java does not.
_SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_FOLDED = r"[\x{17F}\x{212A}]"


def _closed(pattern: str, at: int) -> int:
    """The place behind the group that opens at ``at``."""
    depth, in_class = 0, False
    while True:
        c = pattern[at]
        at += 1
        if c == "\\":
            at += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            at += pattern.startswith("^", at)
            at += pattern.startswith("]", at)
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return at


def re2(pattern: str, ignore_case: bool = True, anchors: bool = False) -> str:
    """``pattern`` as RE2 reads it, without conditions on what stands around: it matches wherever ``pattern`` does.

    Look-arounds go, and unless ``anchors`` are kept, so do ^ and $, which a check
    may mean for a part of the line.
    """
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c, two = pattern[i], pattern[i : i + 2]
        if not in_class and re.match(r"\(\?<?[=!]", pattern[i : i + 4]):
            i = _closed(pattern, i)
        elif c == "\\":
            out.append({"\\s": _SPACE if in_class else f"[{_SPACE}]", "\\S": f"[^{_SPACE}]"}.get(two, two))
            i += 2
        elif not in_class and c in "^$":
            out.append({"^": "^", "$": r"\z"}[c] if anchors else "")
            i += 1
        else:
            if c == "[" and not in_class:
                in_class = True
                if pattern.startswith("^", i + 1):
                    c = "[^"
            elif c == "]":
                in_class = False
            out.append(c)
            i += len(c)
    whole = "".join(out)
    return f"(?i:{whole})|{_FOLDED}" if ignore_case else f"(?:{whole})"


#: What checks make of a line before they look, as in ``scalars``: (pattern, replacement) in turn.
_CODE = ("`[^`]*`", " ")
FORMS: dict[str, list[tuple[str, str]]] = {
    "raw": [],
    "without code": [_CODE],
    "prose": [_CODE, (rf"\]\([^){_SPACE}]*", "](")],
    "readable": [(r"\[([^\]]*)\]\([^)]*\)", r"\1"), ("`[^`]*`", " CODE ")],
}


def marks(lines: str, sieves: list[tuple[str, str]]) -> Column:
    """For each string of the array ``lines`` a number whose bit k tells that sieve k, a form and a pattern, lets it through."""
    if len(sieves) > 63:
        raise ValueError("a mark holds 63 sieves")

    def told(texts: pa.Array) -> pa.Array:
        # A few documents at a time: their lines are held in every form.
        found = np.concatenate([np.zeros(0, dtype=np.int64), *(passed(texts.slice(k, 256).flatten()) for k in range(0, len(texts), 256))])
        sizes = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(found))

    def passed(flat: pa.Array) -> np.ndarray:
        made = {}
        for form, steps in FORMS.items():
            made[form] = flat
            for pattern, put in steps:
                made[form] = pc.replace_substring_regex(made[form], pattern, put)
        found = np.zeros(len(flat), dtype=np.int64)
        for k, (form, pattern) in enumerate(sieves):
            hit = pc.fill_null(pc.match_substring_regex(made[form], pattern), True)
            found |= hit.to_numpy(zero_copy_only=False).astype(np.int64) << k
        return found

    return F.arrow_udf(told, ArrayType(LongType()))(F.col(lines))
