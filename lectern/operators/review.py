"""From findings and candidates to reports, verdicts and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.structure_data import CLASS_EXEMPT, CLASS_PREFIXES, DEFAULT_CLASS

VERDICTS = ["VIOLATION", "NO_VIOLATION", "EXCEPTION_APPLIES", "UNCLEAR"]


def corpus_class(path: Column) -> Column:
    """The class of the first prefix that matches; the list is configuration, so it is one expression."""
    out = F.lit(DEFAULT_CLASS)
    for prefix, name in reversed(CLASS_PREFIXES):
        out = F.when(F.startswith(path, F.lit(prefix)), F.lit(name)).otherwise(out)
    return out


def not_exempt(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """Findings without those of rules that their document's class is exempt from."""
    spark = findings.sparkSession
    rows = [(name, rule) for name, rules in CLASS_EXEMPT.items() for rule in rules]
    exempt = F.broadcast(spark.createDataFrame(rows, "class string, rule_id string"))  # a dozen rows, fixed
    classed = findings.join(docs.select("doc_id", corpus_class(F.col("path")).alias("class")), "doc_id", "left")
    return classed.join(exempt, ["class", "rule_id"], "left_anti").drop("class")


def rollup_by_rule(findings: DataFrame) -> DataFrame:
    """rule_id, check_id, tier, findings, documents."""
    return findings.groupBy("rule_id", "check_id", "tier").agg(F.count(F.lit(1)).alias("findings"), F.count_distinct("doc_id").alias("documents"))


def corpus_summary(findings: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: files, clean files, errors (tier 1), warnings (tier 2), whether a run passes."""
    per = findings.groupBy("doc_id").agg(F.count_if(F.col("tier") == 1).alias("e"), F.count_if(F.col("tier") == 2).alias("w"))
    joined = docs.select("doc_id").join(per, "doc_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.coalesce("e", F.lit(0)) + F.coalesce("w", F.lit(0)) == 0).alias("clean"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"), (F.coalesce(F.sum("e"), F.lit(0)) == 0).alias("passed"),
    )


def document_report(findings: DataFrame) -> DataFrame:
    """doc_id, report: a document's findings as text, errors first, by line."""
    line = F.format_string("%s %s %s", F.when(F.col("line_no").isNull(), "(no line)").otherwise(F.concat(F.lit("L"), F.col("line_no").cast("string"))), F.col("rule_id"), F.col("check_id"))
    entry = F.struct("tier", F.coalesce("line_no", F.lit(0)).alias("at"), line.alias("text"))
    return findings.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "\n").alias("report"))


def manual_queue(rules: DataFrame, types: DataFrame) -> DataFrame:
    """doc_id, rule_id of the rules that only a reader can judge, by document type."""
    return types.join(rules.where("tier = 3"), F.array_contains("doc_types", "all") | F.expr("array_contains(doc_types, doc_type)")).select("doc_id", "rule_id")


def candidate_ids(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with the id by which verdicts name them, and an ordinal, as ids may repeat."""
    named = candidates.join(docs.select("doc_id", "path"), "doc_id")
    base = F.element_at(F.split("path", "/"), -1)
    key = F.concat_ws(":", "rule_id", base, F.col("line_no").cast("string"))
    order = Window.partitionBy("candidate_id").orderBy("path", "generator")
    return named.withColumn("candidate_id", key).withColumn("ord", F.row_number().over(order))


def reconcile(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """candidate_id, problem: every way in which verdicts and candidates do not meet.

    ``candidates``: candidate_id, exception; ``verdicts``: candidate_id, verdict,
    reason, fix, exception_quoted.
    """
    nameless = verdicts.where("candidate_id is null or candidate_id = ''").select("candidate_id", F.lit("missing-id").alias("problem"))
    named = verdicts.where("candidate_id <> ''")
    twice = named.groupBy("candidate_id").count().where("count > 1").select("candidate_id", F.lit("duplicate").alias("problem"))
    once = candidates.groupBy("candidate_id").agg(F.first("exception").alias("exception"))
    met = named.join(once.withColumn("known", F.lit(True)), "candidate_id", "full_outer")
    unknown = met.where("known is null").select("candidate_id", F.lit("unknown").alias("problem"))
    unjudged = met.where("known and verdict is null and reason is null and fix is null").join(named.select("candidate_id").distinct(), "candidate_id", "left_anti").select("candidate_id", F.lit("unjudged").alias("problem"))
    judged = met.where("known").join(named.select("candidate_id").distinct(), "candidate_id", "left_semi")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("verdict").isin(VERDICTS), F.lit(False)), "bad-verdict"),
        F.when(empty("reason"), "no-reason"),
        F.when((F.col("verdict") == "VIOLATION") & empty("fix"), "no-fix"),
        F.when((F.col("verdict") == "EXCEPTION_APPLIES") & (empty("exception_quoted") | ~F.coalesce(F.col("exception").contains(F.col("exception_quoted")), F.lit(False))), "exception-not-quoted"),
    ))
    return nameless.union(twice).union(unknown).union(unjudged).union(judged.select("candidate_id", F.explode(faults).alias("problem")))


def merged_verdicts(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Verdicts by candidate, the fresh one where both have it."""
    both = existing.withColumn("_age", F.lit(1)).unionByName(fresh.withColumn("_age", F.lit(0)))
    first = Window.partitionBy("candidate_id").orderBy("_age", F.desc_nulls_last("verdict"), F.desc_nulls_last("reason"))
    return both.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_age", "_k")


def verdict_findings(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tier-3 findings of the violations among the verdicts; unknown candidates keep null places."""
    once = candidates.groupBy("candidate_id").agg(F.first("doc_id").alias("doc_id"), F.first("line_no").alias("line_no"), F.first("rule_id").alias("rule_id"), F.first("section").alias("section"))
    return verdicts.where("verdict = 'VIOLATION'").join(once, "candidate_id", "left").select(
        "doc_id", "line_no", F.lit(3).alias("tier"), "rule_id", F.lit("tier3-candidates").alias("check_id"), "section"
    )


def cache_key(text: Column, rule: Column, version: str) -> Column:
    """First 16 hex digits of SHA-256 over the normalised sentence, the rule and the prompt version."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[`*_]", ""), r"\s+", " "))
    return F.substring(F.sha2(F.concat_ws("|", plain, rule, F.lit(version)), 256), 1, 16)


def ledger(items: DataFrame, resolutions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """key, kind, rule_id, path, line_no, status: resolution first, then verdict, else open.

    ``items``: kind, rule_id, path, line_no, text, candidate_id.  The key is a hash
    of path, rule and line text; repeated keys are numbered.
    """
    base = F.substring(F.sha1(F.concat_ws("|", "path", "rule_id", F.trim(F.regexp_replace("text", r"\s+", " "))).cast("binary")), 1, 16)
    order = Window.partitionBy("base").orderBy("line_no", "kind")
    keyed = items.withColumn("base", base).withColumn("k", F.row_number().over(order)).withColumn("key", F.when(F.col("k") > 1, F.concat_ws(".", "base", F.col("k").cast("string"))).otherwise(F.col("base")))
    solved = resolutions.groupBy("key").agg(F.first("resolution").alias("resolution"))
    told = verdicts.groupBy("candidate_id").agg(F.first("verdict").alias("verdict"))
    joined = keyed.join(solved, "key", "left").join(told, "candidate_id", "left")
    status = (
        F.when(F.col("resolution").isNotNull(), "resolved").when(F.col("verdict") == "VIOLATION", "violation")
        .when(F.col("verdict").isin("NO_VIOLATION", "EXCEPTION_APPLIES"), "cleared").when(F.col("verdict") == "UNCLEAR", "unclear").otherwise("open")
    )
    return joined.select("key", "kind", "rule_id", "path", "line_no", status.alias("status"))


def ledger_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("items"))


# ---- catalog and corpora -----------------------------------------------------------------------------


def next_rule_ids(rules: DataFrame) -> DataFrame:
    """prefix, next_id: the id that a new rule of each prefix gets."""
    parts = rules.select(F.regexp_extract("rule_id", "^(.*)-[0-9]+$", 1).alias("prefix"), F.regexp_extract("rule_id", "-([0-9]+)$", 1).cast("int").alias("n"))
    return parts.groupBy("prefix").agg(F.max("n").alias("n")).select("prefix", F.concat_ws("-", "prefix", F.lpad((F.col("n") + 1).cast("string"), 2, "0")).alias("next_id"))


def unemitted_rules(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules that claim a check but of which no finding exists."""
    return rules.where("check_id is not null").join(findings.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "check_id")


def mirror_problems(source: DataFrame, mirror: DataFrame) -> DataFrame:
    """name, problem over two folders' (name, text): drift, missing or orphan."""
    s, m = source.select("name", F.col("text").alias("s")), mirror.select("name", F.col("text").alias("m"))
    both = s.withColumn("has_s", F.lit(True)).join(m.withColumn("has_m", F.lit(True)), "name", "full_outer")
    problem = F.when(F.col("has_m").isNull(), "missing").when(F.col("has_s").isNull(), "orphan").when(~F.col("s").eqNullSafe(F.col("m")), "drift")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def probe(hits: DataFrame, findings: DataFrame) -> DataFrame:
    """Each hit of a probed phrase: 'covered' by a finding within a line, else 'gap'.

    The range is three equalities, so the join stays keyed.
    """
    near = findings.select("doc_id", F.explode(F.array(F.col("line_no") - 1, F.col("line_no"), F.col("line_no") + 1)).alias("line_no")).distinct().withColumn("near", F.lit(True))
    return hits.select("doc_id", "line_no").join(near, ["doc_id", "line_no"], "left").select("doc_id", "line_no", F.when(F.col("near"), "covered").otherwise("gap").alias("state"))


def owning_rules(label: str, rules: DataFrame, best: int = 3, floor: float = 0.12) -> DataFrame:
    """The rules whose text shares most words with a probe's label, by Jaccard."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z]+", " "), " "), lambda w: F.length(w) > 3))
    own = words(F.lit(label))
    score = F.size(F.array_intersect(words(F.col("rule")), own)) / F.greatest(F.size(F.array_union(words(F.col("rule")), own)), F.lit(1))
    return rules.select("rule_id", score.alias("score")).where(F.col("score") >= floor).orderBy(F.desc("score"), "rule_id").limit(best)
