"""Queries of the document-quality engine and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.relations import Corpus
from lectern.operators import links, prose, review, rewrites, structure
from lectern.operators.api_ref import API_CHECKS
from lectern.operators.candidates import GENERATORS
from lectern.operators.findings import finding, union
from lectern.operators.registry import CHECKS
from lectern.plans import oracles, sweep
from lectern.sources import corpora

Query = Callable[[SparkSession, str], DataFrame]


def derived(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus(corpora.derived_documents(spark, sf_dir))


def check_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = derived(spark, sf_dir)
        return CHECKS[name](c, structure.doc_types(c))

    return run


#: Checks that the rollup queries run together: those of lines, which share one scan of the lines.
LINE_CHECKS = [
    "em_dash_semicolon", "present_continuous", "embedded_question_phrases", "retry_attempt_count_bold", "conditional_framing", "additional_resource_phrasing",
    "internal_link_form", "typographic_substitutes", "no_emoji", "sentence_concision", "skimmable_sentence", "over_promise", "bare_domain", "qa_headers", "duplicate_links",
]
#: Texts of some rules, as a registry of rules would hold them.
RULE_TEXTS = [("C3-05", "No dashes or semicolons between clauses"), ("C3-19", "Simple present, not present continuous"), ("C3-07", "One idea in a sentence"), ("C8-10", "Promise no more than the product does")]


def all_findings(c: Corpus, names: list[str] | None = None) -> DataFrame:
    """The named checks (all by default) over one corpus, as one relation.

    Each check is its own branch; with all fifty the plan is large, so a sweep
    over a corpus writes branch by branch (see ``plans.sweep``).
    """
    types = structure.doc_types(c)
    return union([CHECKS[n](c, types) for n in names or CHECKS])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present continuous over the raw documents, rolled up by rule."""
    c = Corpus(corpora.plain_documents(spark, sf_dir))
    hits = finding(prose.present_continuous_hits(c.lines), "present-continuous", 2, "C3-19")
    return hits.groupBy("rule_id", "tier").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


def _relation(pick: Callable[[Corpus], DataFrame]) -> Query:
    return lambda spark, sf_dir: pick(derived(spark, sf_dir))


RELATIONS: dict[str, Query] = {
    "lines": _relation(lambda c: c.every_line.select("doc_id", "line_no", F.md5("raw").alias("raw_md5"), "in_fence", "is_body")),
    "fences": _relation(lambda c: c.fences),
    "front_matter": _relation(lambda c: c.front_matter.select("doc_id", "present", F.to_json("keys").alias("keys_json"), "malformed")),
    "headings": _relation(lambda c: c.headings.select("doc_id", "line_no", "level", "text", "end_line")),
    "anchors": _relation(lambda c: c.headings.select("doc_id", "line_no", "anchor")),
    "tables": _relation(lambda c: c.tables.select("doc_id", "start_line", "end_line", F.size("header").alias("columns"), F.size("rows").alias("n_rows"))),
    "links": _relation(lambda c: c.links.select("doc_id", "line_no", "url")),
    "list_items": _relation(lambda c: c.items),
    "sentences": _relation(lambda c: prose.sentence_rows(c, r"^\s*(?:#{1,6}\s|\||>)").select("doc_id", "line_no", "ord", F.md5("sentence").alias("sentence_md5"))),
    "paragraphs": _relation(lambda c: structure.paragraphs(c).drop("text")),
    "document_types": _relation(structure.doc_types),
    "strict_links": _relation(lambda c: links.extracted(c).drop("path")),
    "link_counts": _relation(links.link_counts),
    "internal_links": _relation(links.internal_links),
    "misleading_labels": _relation(links.misleading_labels),
}


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Corpus(corpora.derived_pages(spark, sf_dir)).headings.select("doc_id", "line_no", "level", "text")


def _over_findings(then: Callable[[DataFrame, Corpus], DataFrame]) -> Query:
    """A query over the findings of the line checks."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = derived(spark, sf_dir)
        return then(all_findings(c, LINE_CHECKS), c)

    return run


def _over_sweep(then: Callable[[DataFrame, Corpus], DataFrame]) -> Query:
    """A query over the findings of all checks, without those that documents are exempt from."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = derived(spark, sf_dir)
        return then(review.not_exempt(sweep.sweep(c), c.docs), c)

    return run


def _with_text(f: DataFrame, c: Corpus) -> DataFrame:
    rules = f.sparkSession.createDataFrame(RULE_TEXTS, "rule_id string, rule string")
    return sweep.with_rule_text(f, rules).groupBy("rule_id", "rule").agg(F.count(F.lit(1)).alias("findings"))


def first_use_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = derived(spark, sf_dir)
    return rewrites.acronym_rewrites(c, prose.acronym_first_use(c))


def dash_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems that the dash rewrites cause, by the integrity checks: each line as a document."""
    rows = rewrites.rewrites(derived(spark, sf_dir), "dashes").where("clean")
    pairs = rows.select(F.struct("doc_id", "line_no").alias("doc_id"), "before", "after")
    return rewrites.edit_problems(pairs).groupBy("problem").agg(F.count(F.lit(1)).alias("lines"))


def renamed_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug map when every heading that ends in a question mark loses it and gains a word."""
    c = derived(spark, sf_dir)
    heads = c.headings.join(c.docs.select("doc_id", "path"), "doc_id").select("path", "line_no", "text")
    return rewrites.slug_map(heads, heads.withColumn("text", F.regexp_replace("text", r"\?\z", " answered")))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of the routing candidates with verdicts derived from their ids."""
    c = derived(spark, sf_dir)
    rows = review.candidate_ids(GENERATORS["routing_only"](c), c.docs).withColumn("exception", F.lit("None."))
    k = F.pmod(F.col("doc_id"), F.lit(7))
    verdict = F.element_at(F.array(*map(F.lit, ("VIOLATION", "NO_VIOLATION", "EXCEPTION_APPLIES", "UNCLEAR", "MAYBE", "VIOLATION", "UNCLEAR"))), (k + 1).cast("int"))
    told = rows.where(k != 6).select(
        F.when(k == 3, F.concat(F.col("candidate_id"), F.lit("x"))).otherwise(F.col("candidate_id")).alias("candidate_id"), verdict.alias("verdict"),
        F.when(k != 1, "seen").alias("reason"), F.when(k == 0, "fix").alias("fix"), F.when(k == 2, "None.").alias("exception_quoted"),
    )
    return review.reconcile(rows, told).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


QUERIES: dict[str, Query] = {
    "flagship": flagship,
    **{f"check_{name}": check_query(name) for name in CHECKS},
    **RELATIONS,
    "page_headings": page_headings,
    **{f"api_{name}": (lambda spark, sf_dir, check=check: check(Corpus(corpora.derived_api_pages(spark, sf_dir)))) for name, check in API_CHECKS.items()},
    **{f"candidates_{name}": _relation(g) for name, g in GENERATORS.items()},
    "candidate_counts": _relation(lambda c: sweep.sweep_candidates(c).groupBy("rule_id", "generator").agg(F.count(F.lit(1)).alias("candidates"))),
    **{f"rewrite_{family}": (lambda spark, sf_dir, family=family: rewrites.rewrites(derived(spark, sf_dir), family)) for family in rewrites.FAMILIES},
    "rewrite_acronyms": first_use_rewrites,
    "dash_edit_integrity": dash_edits,
    "renamed_anchors": renamed_anchors,
    "reconcile_verdicts": reconciled,
    "rollup_by_rule": _over_findings(lambda f, c: review.rollup_by_rule(review.not_exempt(f, c.docs))),
    "corpus_summary": _over_findings(lambda f, c: review.corpus_summary(review.not_exempt(f, c.docs), c.docs)),
    "rule_text_rollup": _over_findings(_with_text),
    "first_tier_findings": _over_findings(lambda f, c: f.where("tier = 1").select("doc_id", "line_no", "rule_id", "check_id")),
    "sweep_rollup_by_rule": _over_sweep(lambda f, c: review.rollup_by_rule(f)),
    "sweep_summary": _over_sweep(lambda f, c: review.corpus_summary(f, c.docs)),
    "document_reports": _over_sweep(lambda f, c: review.document_report(f)),
    "json_reports": _over_findings(lambda f, c: sweep.json_reports(f)),
}

ORACLE_SQL: dict[str, str] = {"flagship": oracles.flagship(), **oracles.checks(), **oracles.relations(), **oracles.rollups(RULE_TEXTS), **oracles.candidates()}
