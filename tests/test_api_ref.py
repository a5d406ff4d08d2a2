"""API reference pages: a good library is silent but for what it lacks, a bad one is not."""

from __future__ import annotations

from lectern.functions.relations import Corpus
from lectern.operators.api_ref import API_CHECKS
from lectern.sources.snippets import CLASS_PAGES, GUIDE_PAGES, METHOD_PAGES


def test_rules_by_page(spark):
    docs = [
        (1, "api/good/usage_guide.md", GUIDE_PAGES[0]), (2, "api/good/k0/class_reference.md", CLASS_PAGES[0]), (3, "api/good/k0/methods/m1.md", METHOD_PAGES[0] + "---\n"),
        (4, "api/good/k0/methods/m2.md", METHOD_PAGES[0].replace("### m1", "### m2").replace("[x](m2.md)", "[x](m1.md)") + "---\n"),
        (5, "api/bad/usage_guide.md", GUIDE_PAGES[1]), (6, "api/bad/k0/class_reference.md", CLASS_PAGES[1]), (7, "api/bad/k0/methods/m1.md", METHOD_PAGES[1]),
    ]
    c = Corpus(spark.createDataFrame(docs, "doc_id long, path string, text string"))
    found: dict[int, set[str]] = {}
    for check in API_CHECKS.values():
        for r in check(c).collect():
            found.setdefault(r.doc_id, set()).add(r.rule_id)
    assert found.get(1, set()) == {"AR-09"}  # its links to pages outside the corpus are dead
    assert 2 not in found and 3 not in found and 4 not in found
    assert {"UG-01", "UG-02", "UG-03", "UG-04", "UG-05", "UG-06", "UG-08", "UG-09", "UG-10", "UG-11", "UG-12", "UG-13"} <= found[5]
    assert {"AR-01", "AR-02", "AR-05", "AR-07", "AR-08", "AR-09"} <= found[6]
    assert {"AR-01", "AR-02", "AR-03", "AR-04", "AR-05", "AR-06", "AR-07", "AR-09"} <= found[7]
