"""Sieves: what they let through is all that a check can report."""

from __future__ import annotations

import re

import pytest

from lectern.functions.relations import Corpus
from lectern.functions.sieve import re2
from lectern.operators import structure
from lectern.operators.candidates import GENERATORS, fact_groups
from lectern.operators.registry import CHECKS
from lectern.operators.sieves import SIEVES
from lectern.plans import sweep
from lectern.sources.snippets import SNIPPETS


@pytest.fixture(scope="module")
def plain(spark):
    odd = [
        "## Odd\n\nIt iſ running. It stops after two `x` attempts.\n\nThe file i`a`s `b` sent. The value is `x` being read.\nOpen VS`x`Code now.\n",
        "## Long\n\n" + " ".join(["word."] * 3 + ["Some", "words"] * 20) + " a. b\n\n- " + "one, two or three " * 12 + "\n\n> Note: Three of the following:\n\n- a\n- b\n",
        "## Code\n\nA `b. C` hold `d` and more, but `e, f` yet.\nUse the three\n\nYou must never. If x, either y.\n|a|\n|-|\n",
    ]
    rows = [(k, f"docs/{k}.md", text) for k, text in enumerate([*SNIPPETS, *odd, "", None])]
    return Corpus(spark.createDataFrame(rows, "doc_id long, path string, text string"))


@pytest.fixture(scope="module")
def kept(plain):
    return sweep.stored(plain, "every_line", "found_line", "sectioned", "items", "links", "tables")


def test_re2_keeps_what_a_pattern_can_match():
    assert re.search(r"17F", re2("just")) and "?<!" not in re2(r"(?<!\bnot )\bjust\b(?=\s*(?:[.)]|$))") and re2(r"^a\s$", False) == re2(r"a\s", False)
    assert re2(r"[^\s.?!]x", False).startswith(r"(?:[^\t") and len(SIEVES) <= 63


def test_only_lines_and_documents_that_may_match_are_read(plain, kept):
    assert {r.raw for r in kept.may("attempt").collect()} == {r.raw for r in plain.lines.collect() if "attempt" in r.raw.lower()}
    assert 0 < kept.only("vendor").parsed.count() < 3 < plain.parsed.count() == kept.parsed.count() == plain.only("vendor").parsed.count()
    assert sorted(kept.may("skimmable").columns) == sorted(plain.lines.columns)
    assert kept.found_line.count() < kept.marked_line.count()


@pytest.mark.parametrize("name", [
    "banned_phrases", "passive_voice", "present_continuous", "retry_attempt_count_bold", "skimmable_sentence", "sentence_concision", "third_party_ui", "no_italics", "vague_reference",
    "acronym_first_use", "ordered_list_sequence", "heading_length", "table_restatement", "embedded_question_phrases",
])
def test_checks_find_the_same_behind_sieves(plain, kept, name):
    asks = lambda c: sorted(map(str, CHECKS[name](c, structure.doc_types(c)).collect()))
    assert asks(kept) == asks(plain) != []


@pytest.mark.parametrize("name", ["house_verbs", "false_contrast", "circled_concept", "numeric_consistency", "unanchored_block", "unnamed_lead_in", "missing_destination", "prose_as_table", "consequence_order"])
def test_generators_find_the_same_behind_sieves(plain, kept, name):
    asks = lambda c: sorted(map(str, GENERATORS[name](c).collect()))
    assert asks(kept) == asks(plain) != []


def test_facts_are_grouped_in_order():
    a, b, c = "the quick brown fox jumps over it", "the quick brown fox jumps over you", "nothing else is said here at all"
    assert fact_groups([a, b, c], 0.5) == [{"m": 0, "i": 0}, {"m": 1, "i": 0}]
    assert fact_groups([c, a, c, "few words"], 0.5) == [{"m": 0, "i": 0}, {"m": 2, "i": 0}]
    assert fact_groups([a, b], 0.9) == []


def test_sections_alike_are_paired_by_sets():
    w = [f"w{k}" for k in range(30)]
    assert structure.like_pairs([" ".join(w), "a b", " ".join([*w, "more"]), " ".join(w[:12])]) == [{"a": 0, "b": 2}]
    assert structure.like_pairs([" ".join(w)]) == structure.like_pairs(["a b c d", "a b c d"]) == []


def test_sections_of_few_paragraphs_are_left_out_early(plain):
    every, some = (sorted(map(str, structure.paragraphs(plain, k).collect())) for k in (1, 3))
    held = {}
    for r in structure.paragraphs(plain).collect():
        held.setdefault((r.doc_id, r.section_line), []).append(str(r))
    assert some == sorted(x for rows in held.values() if len(rows) >= 3 for x in rows) and 0 < len(some) < len(every)


def test_a_sweep_hands_sieves_to_every_check(plain):
    seen = []

    def asks(c, types):
        seen.append((set(c.sieves), c.may("attempt").inputFiles()))
        return CHECKS["retry_attempt_count_bold"](c, types)

    found = sweep.sweep(plain, checks={"asks": asks})
    assert found.count() == CHECKS["retry_attempt_count_bold"](plain, None).count() > 0
    assert seen[0][0] == set(SIEVES) and all("/found_line-" in f for f in seen[0][1])
