"""Parsing of Markdown into relations: edge cases stated by hand."""

from __future__ import annotations

import pytest

from lectern.functions.relations import Corpus

DOCS = {
    1: "---\nurl: a\nbad line\nurl: b\n- item\n---\n# T\n\n## A\n\ntext\n\n### A1\n\n## A\n\n#### Deep\n",
    2: "---\nurl: a\n\n# T\n",
    3: "```\n~~~\n# no\n```\n# yes\n~~~\n# no\n",
    4: "> ```js\n> # no\n> ```\n# yes #\n",
    5: "| a | b |\n| --- | --- |\n| c |\n\n| x |\n| --- |\n\n```\n| a | b |\n| --- | --- |\n```\n| a | b |\n| :-- | --: |\n| 1 | 2 |\n| 3 | 4 |",
    6: None,
    7: "",
    8: "- [a](b).\n- [c](d) e\n1. x\n  2) y\n![i](j) `[k](l)`\r\nend",
}


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus(spark.createDataFrame([(k, f"docs/{k}.md", v) for k, v in DOCS.items()], "doc_id long, path string, text string"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_front_matter_last_key_wins_and_bad_lines_are_listed(corpus):
    found = {r.doc_id: r for r in corpus.front_matter.collect()}
    assert found[1].present and found[1].keys == {"url": "b"} and found[1].malformed == [3]
    assert not found[2].present and not found[6].present


def test_headings_sections_and_anchors(corpus):
    got = rows(corpus.headings.where("doc_id = 1"), "line_no", "level", "text", "end_line", "anchor")
    assert got == [(7, 1, "T", 18, "t"), (9, 2, "A", 14, "a"), (13, 3, "A1", 14, "a1"), (15, 2, "A", 18, "a-1"), (17, 4, "Deep", 18, "deep")]


def test_fences_close_on_their_own_character_only(corpus):
    assert rows(corpus.headings.where("doc_id = 3"), "line_no", "text") == [(5, "yes")]
    assert rows(corpus.fences.where("doc_id = 3"), "start_line", "end_line") == [(1, 4), (6, 8)]
    assert rows(corpus.headings.where("doc_id = 4"), "text") == [("yes",)]


def test_tables_need_two_columns_and_stay_out_of_fences(corpus):
    got = rows(corpus.tables.where("doc_id = 5"), "start_line", "end_line")
    assert got == [(1, 3), (12, 15)]


def test_null_and_empty_documents_have_one_empty_line(corpus):
    assert rows(corpus.every_line.where("doc_id in (6, 7)"), "doc_id", "line_no", "raw") == [(6, 1, ""), (7, 1, "")]


def test_links_and_items(corpus):
    assert rows(corpus.links.where("doc_id = 8"), "line_no", "url", "bare") == [(1, "b", True), (2, "d", False), (5, "j", False), (5, "l", False)]
    assert rows(corpus.items.where("doc_id = 8"), "line_no", "indent", "ordered") == [(1, 0, False), (2, 0, False), (3, 0, True), (4, 2, True)]


def test_empty_table(spark):
    none = Corpus(spark.createDataFrame([], "doc_id long, path string, text string"))
    assert none.every_line.count() == 0 and none.headings.count() == 0
