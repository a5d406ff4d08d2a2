"""Checks on lines that violate a rule, each beside a near miss."""

from __future__ import annotations

import pytest

from lectern.functions.relations import Corpus
from lectern.functions.scalars import masked, row_faults, status_codes, word_distance
from lectern.operators import rewrites, structure
from lectern.operators.registry import CHECKS

CASES = {
    "em_dash_semicolon": ("a — b\n`a; b`\n&amp; ok\none; two\n", [1, 4]),
    "present_continuous": ("it is holding\nit is missing\nété is holding it\n`is running`\n", [1, 3]),
    "banned_phrases": ("it is just that\nnot just that\n`just`\na seamless flow\n", [1, 4]),
    "anthropomorphism": ("The server decides it.\nYou decide it.\nIgnore it.\nThe OAuth server refuses it.\nThe parser ignores it and users want it.\n", [1, 5]),
    "passive_voice": ("It was created by them.\nThe Key Is Written Here.\nIt is based on x.\n", [1]),
    "over_promise": ("it never fails and always works\nno guarantee here\n", [1]),
    "error_code_format": ("It returns 404.\nUp to 200 items.\nPort 443.\n301 and 302\nHTTP 301 and 302\n", [1, 5]),
    "embedded_question_phrases": ("this shows how it works\nHow to\nhow to\n", [1]),
    "retry_attempt_count_bold": ("three attempts\n**three attempts** and two attempts\n**two attempts**\n", [1, 2]),
    "no_emoji": ("a → b\n(c) © only\n`→`\n", [1]),
    "typographic_substitutes": ("a · b\n5° ok\n", [1]),
    "no_italics": ("an *x* y\nsnake_case_a b\n2 * 3 * 4\n<em>x</em>\n**b**\n", [1, 4]),
    "bare_domain": ("visit a.io now\n`b.io`\n[c.io](http://c.io)\nme@d.io\n", [1]),
    "acronym_first_use": ("the CDN\na content delivery network (CDN)\n", [1]),
    "qa_headers": ("## Why?\n\n## FAQ\n\n### What?\n", [1]),
    "heading_length": ("## One two three four five\n\n## a lower one\n\n## npx tool\n\n## Fine One\n", [1, 3]),
    "troubleshooting_format": ("## Troubleshooting\n\n### E\n\n**Resolution** x\n\n**Root Cause** y\n", [3]),
    "table_integrity": ("| a | b |\n| --- | --- |\n| c |\n| `d|e` | f |\n| (g | h |\n", [3, 5]),
    "duplicate_links": ("[a](x) [b](x)\n[c](y)\n", [1]),
    "callout_taxonomy": ("> **Note:** x\n> **Danger:** y\n", [2]),
    "conditional_framing": ("If you see x, run y\nIf you see x, then y\n", [1]),
    "anchor_heading_level": ("[x](#d) [y](#e)\n\n#### D\n\n### E\n", [1]),
    "vague_reference": ("Use this command:\nUse this command here.\nlast\n", [1]),
    "ordered_list_sequence": ("Facts:\n\n1. Apples\n2. Pears\n\nIn this order:\n\n1. Apples\n2. Pears\n", [3]),
}


@pytest.fixture(scope="module")
def found(spark):
    names = list(CASES)
    c = Corpus(spark.createDataFrame([(i, f"docs/{i}.md", CASES[n][0]) for i, n in enumerate(names)], "doc_id long, path string, text string"))
    types = structure.doc_types(c)
    return {n: sorted({r.line_no for r in CHECKS[n](c, types).where(f"doc_id = {i}").collect()}) for i, n in enumerate(names)}


@pytest.mark.parametrize("name", list(CASES))
def test_check(found, name):
    assert found[name] == CASES[name][1]


@pytest.mark.parametrize("line", ["a `b; c` &amp; <i>x</i>", '<img alt="a — b" src="c;d">', "[x](a;b) https://x.y/a;b.", "plain"])
def test_masks_keep_length(line):
    assert len(masked(line)) == len(line) and len(masked(line, "x")) == len(line)


def test_attribute_text_stays_open():
    assert "—" in masked('<img alt="a — b" src="c;d">') and ";" not in masked('<img alt="a — b" src="c;d">')


def test_scalars():
    assert row_faults("| **a | (b |") == [1, 2] and row_faults("| a | b |") == []
    assert status_codes("returns 404 or 500 errors") == ["404", "500"]
    assert word_distance("a b c d e f", "a b", 3) and not word_distance("a b c", "a x c", 1)


@pytest.mark.parametrize(("line", "after"), [
    ("# A — b", "# A: b"), ("- **x** — y", "- **x**: y"), ("a — b c — d", "a (b c) d"), ("pages 3–5 here", "pages 3 to 5 here"),
    ("one two three; four five", "one two three. Four five"), ("| a | — |", "| a | - |"), ("`a — b`", "`a — b`"),
])
def test_dash_rewrites(line, after):
    rules, offends, _ = rewrites.FAMILIES["dashes"]
    out, _, clean = rewrites.rewrite(line, rules, offends)
    assert out == after and clean and rewrites.rewrite(out, rules, offends)[0] == out


def test_edit_integrity(spark):
    pairs = spark.createDataFrame([
        (1, "a `b` c", "a c"), (2, "x\ny", "x"), (3, "> q", "q"), (4, "same", "same"), (5, "| a | b |", "| a |"), (6, "one two", "uno dos tres quatro cinco seis"),
    ], "doc_id long, before string, after string")
    got = sorted((r.doc_id, r.problem) for r in rewrites.edit_problems(pairs).collect())
    assert got == [(1, "inline-code"), (2, "line-count"), (3, "quote-depth"), (5, "table-shape"), (6, "wording")]
