"""The sieves of all checks and generators by name: the form of a line they look at, and an RE2 pattern.

A check that cuts code and targets sentence by sentence can pair other back ticks
than the line does, so lines that hold any pass its sieve.
"""

from __future__ import annotations

from lectern.functions.patterns import any_of
from lectern.functions.sieve import re2
from lectern.operators import candidates, prose
from lectern.operators.structure_data import ACRONYMS
from lectern.operators.wordlist_data import WORDLISTS
from lectern.operators.wordlists import pattern_of

_CUT = r"|`|\]\("


def _listed(name: str) -> str:
    return any_of([pattern_of(e) for e in WORDLISTS[name]])


def _run(gaps: int) -> str:
    """So many gaps between words at none of which a sentence ends."""
    return re2(rf"(?:(?:\S*[^\s.?!])?\s+|\S*[.?!]\s+[^\sA-Z`\"'(]){{{gaps}}}", False)


_COUNT = rf"\b(?:{'|'.join([*candidates.NUMBERS, 'both'])}|[2-9]|[1-9][0-9])\b"
_POINTS = r"\b(?:below|above|following|here|listed|these|those|next)\b"

SIEVES: dict[str, tuple[str, str]] = {
    **{name: ("without code", re2(_listed(name))) for name in ("banned-phrases", "metaphors", "periphrasis", "passive-voice")},
    **{name: ("prose", re2(_listed(name))) for name in ("over-promise", "anthropomorphism", "vague-reference")},
    "house-verbs": ("raw", re2(_listed("house-verbs")) + _CUT),
    "dash": ("raw", "[—–;]"),
    "continuous": ("without code", re2(prose.CONTINUOUS)),
    "number": ("raw", "[1-5][0-9]{2}"),
    "how": ("without code", re2(r"\S[ \t]how\b")),
    "attempt": ("raw", re2("attempt")),
    "conditional": ("raw", re2(r"\bif you (see|notice)\b")),
    "substitutes": ("raw", prose.SUBSTITUTES),
    "emoji": ("raw", f"[{prose.ARROWS_AND_MARKS}{prose.PICTOGRAPHS}]"),
    "emphasis": ("raw", re2(r"[*_]|</?(?:em|i)\b")),
    "open star": ("raw", re2(r"(?:^|[^*\w])\*[^\s*]", False, True)),
    "quote": ("raw", "^>"),
    "additional": ("raw", "Additional Resource"),
    "domain": ("raw", re2(rf"[a-z0-9]\.(?:{prose.TLDS})")),
    "docs site": ("raw", prose.DOCS_SITE),
    "code": ("raw", "`"),
    "link": ("raw", r"\]\("),
    "acronym": ("without code", any_of([a for a, _ in ACRONYMS]) + "|" + re2(any_of([f for _, f in ACRONYMS]))),
    "concision": ("readable", _run(28) + "|" + re2(rf"{_listed('wordy')}|\b(because|since|so that|so it|therefore)\b")),
    "skimmable": ("readable", _run(30)),
    "vendor": ("without code", re2(rf"\b(?:{'|'.join(prose.VENDORS)})\b", False)),
    "ordered item": ("raw", re2(r"^\s*\d+[.)]\s", False, True)),
    "long heading": ("raw", re2(r"^ {0,3}#{1,6}\s+\S+(?:\s+\S+){4}", False, True)),
    "pipe": ("raw", r"\|"),
    "fence": ("raw", "```|~~~"),
    "install": ("raw", "plugins:install"),
    "block": ("raw", re2(r"^\s*\||^\s*!\[", False, True) + "|```|~~~"),
    "colon": ("raw", re2(r":\s*$", False, True)),
    "contrast": ("raw", re2(r",\s+(but|yet)\s+|\b(however|though|whereas)\b") + _CUT),
    "circled": ("prose", re2(any_of([described for _, described in candidates.CONCEPTS]))),
    "gerund": ("raw", re2(r"[A-Z][a-z]+ing\b|,\s+(?:so|and|but)\s+([a-z]+ing)\b", False)),
    "enumeration": ("without code", re2(candidates.CHANGES)),
    "quantifier": ("without code", re2(candidates.QUANTIFIER)),
    "defect": ("raw", re2(candidates.DEFECT)),
    "disclosure": ("raw", re2(candidates.DISCLOSURE)),
    "hover": ("raw", re2(candidates.HOVER)),
    "hand-off": ("raw", re2(candidates.HAND_OFF)),
    "strong": ("raw", re2(candidates.STRONG)),
    "parallel": ("raw", re2(r"\b(if|either|whereas|instead|alternatively|when|for)\b")),
    "actor": ("raw", re2(rf"\b({'|'.join(candidates.ACTORS)})\b", False)),
    "claim": ("prose", re2(rf"{_listed('over-promise')}|{candidates.CLAIM}")),
    "casual": ("prose", re2(candidates.CASUAL)),
    "pointing count": ("raw", re2(rf"{_COUNT}.*{_POINTS}|{_POINTS}.*{_COUNT}|^#{{1,6}}\s.*{_COUNT}|{_COUNT}.*:\s*$", True, True)),
}

#: Sieves that pass much of plain prose: a table of what the others find leaves their lines out.
COMMON = frozenset({"concision", "skimmable", "gerund", "parallel"})
