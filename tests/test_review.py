"""Reconciliation, ledgers, links and catalog tools on small tables."""

from __future__ import annotations

from lectern.functions.relations import Corpus
from lectern.operators import links, review


def test_reconcile_names_every_problem(spark):
    candidates = spark.createDataFrame([("a", "None."), ("b", "x y"), ("c", "z"), ("d", "z"), ("e", "z")], "candidate_id string, exception string")
    verdicts = spark.createDataFrame([
        ("a", "VIOLATION", "r", None, None), ("b", "EXCEPTION_APPLIES", "r", None, "y"), ("c", "EXCEPTION_APPLIES", "", None, "q"), ("d", "ODD", "r", None, None),
        ("d", "UNCLEAR", "r", None, None), ("zz", "UNCLEAR", "r", None, None), (None, "UNCLEAR", "r", None, None),
    ], "candidate_id string, verdict string, reason string, fix string, exception_quoted string")
    got = sorted((r.candidate_id or "", r.problem) for r in review.reconcile(candidates, verdicts).collect())
    assert got == [("", "missing-id"), ("a", "no-fix"), ("c", "exception-not-quoted"), ("c", "no-reason"), ("d", "bad-verdict"), ("d", "duplicate"), ("e", "unjudged"), ("zz", "unknown")]


def test_fresh_verdicts_win(spark):
    schema = "candidate_id string, verdict string, reason string"
    old = spark.createDataFrame([("a", "UNCLEAR", "o"), ("b", "UNCLEAR", "o")], schema)
    new = spark.createDataFrame([("a", "VIOLATION", "n")], schema)
    assert sorted((r.candidate_id, r.verdict) for r in review.merged_verdicts(old, new).collect()) == [("a", "VIOLATION"), ("b", "UNCLEAR")]


def test_ledger_numbers_repeated_keys(spark):
    items = spark.createDataFrame([("lint", "R", "p", 1, "x", "c1"), ("lint", "R", "p", 2, "x", "c2"), ("judge", "R", "p", 3, "y", "c3")], "kind string, rule_id string, path string, line_no int, text string, candidate_id string")
    verdicts = spark.createDataFrame([("c3", "VIOLATION")], "candidate_id string, verdict string")
    rows = review.ledger(items, spark.createDataFrame([], "key string, resolution string"), verdicts).orderBy("line_no").collect()
    assert rows[1].key == rows[0].key + ".2" and [r.status for r in rows] == ["open", "open", "violation"]


def test_next_ids_and_mirror(spark):
    rules = spark.createDataFrame([("C3-09",), ("C3-33",), ("AR-01",)], "rule_id string")
    assert sorted(tuple(r) for r in review.next_rule_ids(rules).collect()) == [("AR", "AR-02"), ("C3", "C3-34")]
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "name string, text string")
    b = spark.createDataFrame([("x", "1"), ("y", "2"), ("w", "1")], "name string, text string")
    assert sorted(tuple(r) for r in review.mirror_problems(a, b).collect()) == [("w", "orphan"), ("y", "drift"), ("z", "missing")]


def test_internal_links(spark):
    docs = [(1, "docs/a.md", "# A\n\n[b](sub/b.md#deep) [c](gone.md) [d](#a) [e](#x) [f](sub) [g](sub#y)\n"), (2, "docs/sub/b.md", "#### Deep\n\n[up](../a.md)\n")]
    c = Corpus(spark.createDataFrame(docs, "doc_id long, path string, text string"))
    got = sorted((r.doc_id, r.ord, r.problem) for r in links.internal_links(c).collect())
    assert got == [(1, 0, "deep-anchor"), (1, 1, "missing-file"), (1, 3, "dead-anchor"), (1, 5, "unresolvable-anchor")]


def test_link_kinds(spark):
    docs = [(1, "a.md", "[a](http://x.y) [b](mailto:q) [c](//z) [d](#e) [f](g.md) ![h](i.png) <a href=\"j\">k</a> `[l](m)`\n")]
    c = Corpus(spark.createDataFrame(docs, "doc_id long, path string, text string"))
    assert sorted((r.kind, r.links, r.images, r.html_links) for r in links.link_counts(c).collect()) == [("external", 2, 0, 0), ("relative", 3, 1, 1), ("same-page", 1, 0, 0), ("scheme", 1, 0, 0)]
