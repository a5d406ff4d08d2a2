"""Sweeps: failed checks show as findings, tiers are filtered, rule texts and reports are joined."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.functions.patterns import needles, spark as java
from lectern.functions.relations import Corpus
from lectern.functions.scalars import strip
from lectern.operators.candidates import GENERATORS
from lectern.operators.registry import CHECKS
from lectern.plans import sweep


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "docs/a.md", "# A\n\nThe team is running it — now.\n"), (2, "docs/b.md", "# B\n\nAll good.\n"), (3, "docs/c.md", None)]
    return Corpus(spark.createDataFrame(rows, "doc_id long, path string, text string"))


def broken(c, types):
    raise PySparkException("no such column")


def test_a_failed_check_is_a_finding_of_every_document(corpus):
    some = {n: CHECKS[n] for n in ("em_dash_semicolon", "present_continuous")}
    found = sweep.sweep(corpus, checks={**some, "broken": broken})
    assert sorted((r.doc_id, r.rule_id) for r in found.collect()) == [(1, "C3-05"), (1, "C3-19"), (1, "LD-00"), (2, "LD-00"), (3, "LD-00")]
    assert {r.tier for r in sweep.sweep(corpus, tiers=(2,), checks=some).collect()} == {2}
    rules = corpus.docs.sparkSession.createDataFrame([("C3-05", "no dashes"), ("C3-05", "no dashes")], "rule_id string, rule string")
    told = {(r.rule_id, r.rule) for r in sweep.with_rule_text(found, rules).collect()}
    assert told == {("C3-05", "no dashes"), ("C3-19", sweep.NO_TEXT), ("LD-00", sweep.NO_TEXT)}
    reports = {r.doc_id: json.loads(r.report) for r in sweep.json_reports(found).collect()}
    assert [x["ruleId"] for x in reports[1]] == ["LD-00", "C3-05", "C3-19"]


def test_a_failed_generator_is_a_candidate(corpus):
    def fails(c):
        raise PySparkException("no such column")

    rows = sweep.sweep_candidates(corpus, {"fails": fails}).collect()
    assert sorted((r.doc_id, r.rule_id, r.generator) for r in rows) == [(k, sweep.FAILED_GENERATOR, "fails") for k in (1, 2, 3)]


def test_needles_are_held_by_every_match():
    assert needles(r"\bComing Soon\b") == ["coming soon"] and needles(r"\w+") is None and needles(r"(?:x|yy)") is None
    assert sorted(needles(r"\b(?:is|are)\s+(?:sent|read)s?\b")) == ["read", "sent"]
    assert java(r"\bab\b").count("(?") == 2 and java(r"\b(a|b)\b").count("(?<=") == 2


def test_documents_of_one_partition_are_dealt_to_all_cores(spark):
    rows = [(k, f"docs/{k}.md", f"# Page {k}\n\nThe team is running it.\n") for k in range(400)]
    one = Corpus(spark.createDataFrame(rows, "doc_id long, path string, text string").coalesce(1))
    parsed = sweep.stored(one).parsed
    parts = parsed.select("doc_id", F.input_file_name().alias("f")).collect()
    assert sorted(r.doc_id for r in parts) == list(range(400))
    assert len({r.f for r in parts}) >= 2 * spark.sparkContext.defaultParallelism
    found = sweep.sweep(one, checks={n: CHECKS[n] for n in ("em_dash_semicolon", "present_continuous")})
    assert sorted(r.doc_id for r in found.collect()) == list(range(400))


def test_what_many_checks_ask_for_is_made_once(corpus):
    files = {}

    def asks(c, types):
        files.update({"types": types.inputFiles(), "every_line": c.every_line.inputFiles()})
        return CHECKS["em_dash_semicolon"](c, types)

    assert [r.doc_id for r in sweep.sweep(corpus, checks={"asks": asks}).collect()] == [1]
    assert all(found and all(f"/{name}-" in f for f in found) for name, found in files.items())
    kept = sweep.stored(corpus, "sectioned")
    assert all("/sectioned-" in f for f in kept.sectioned.inputFiles())
    assert sorted(kept.sectioned.collect()) == sorted(corpus.sectioned.collect())
    assert sorted(sweep.stored(corpus, "every_line").every_line.collect()) == sorted(corpus.every_line.collect())
    none = corpus.docs.select(F.raise_error(F.lit("gone")).cast("long").alias("doc_id"))
    assert not sweep._kept(none, "broken").inputFiles()


def test_white_space_is_one_class_for_patterns_and_trims(spark):
    white = {*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF}
    points = [*range(0xD800), *range(0xE000, 0x10000), 0x1F600]
    rows = spark.createDataFrame([(k, chr(k)) for k in points], "k int, c string")
    told = rows.select("k", F.col("c").rlike(java(r"^\s$")), ~F.col("c").rlike(java(r"^\S$")), F.col("c").rlike(java(r"^[\s#]$")) & (F.col("k") != 35), strip(F.concat("c", F.lit("x"), "c")) == "x")
    assert {k for k, *found in told.collect() if any(found)} == {k for k, *found in told.collect() if all(found)} == white


def test_repeated_sentences_are_grouped_around_the_first(spark):
    same = "The quick brown fox jumps over the lazy dog today."
    near = "The quick brown fox jumps over the lazy dog now."
    text = f"# T\n\n## One\n\n{same}\n\n## Prerequisites\n\n{near}\n\n## Two\n\n{same}\nNothing else here is said twice in any other way.\n"
    c = Corpus(spark.createDataFrame([(1, "a.md", text), (2, "b.md", f"## One\n\n{same}\n"), (3, "c.md", f"## One\n\n{same}\n\n{same}\n")], "doc_id long, path string, text string"))
    rows = sorted((r.doc_id, r.line_no, r.also_covers, r.section) for r in GENERATORS["repeated_fact"](c).collect())
    assert rows == [(1, 5, "C7-02", "One"), (3, 3, "", "One")]


def test_sections_that_share_over_half_are_duplicates(spark):
    words = " ".join(f"w{k}" for k in range(20))
    text = f"## A\n\n{words}\n\n## B\n\n{words} more\n\n## C\n\n{words} {' '.join(f'x{k}' for k in range(20))}\n\n## D\n\nfour words are few\n"
    c = Corpus(spark.createDataFrame([(1, "a.md", text)], "doc_id long, path string, text string"))
    assert [(r.doc_id, r.line_no) for r in CHECKS["duplicate_sections"](c, None).collect()] == [(1, 5)]
