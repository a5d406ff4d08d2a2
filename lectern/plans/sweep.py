"""All checks over a corpus, check by check, and what is made of their findings.

One plan of fifty checks is too large to plan quickly, so documents are parsed
once into a table of the shared folder and each check appends its findings there.
Lines, lines by section and types of documents, which many checks ask for, are
made once as well.  What lines may match which checks is told in the same pass
(``operators.sieves``), so a check reads the few lines or documents that concern it.
Documents are dealt out evenly before they are parsed, as a file of one row group
would leave every check to one task, and a few checks run at a time, so that the
planning and the last tasks of one leave no machine idle.
A check that fails does not end the sweep and does not look like a clean corpus:
its error becomes a finding of every document.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.relations import Corpus
from lectern.functions.sieve import marks
from lectern.operators import structure
from lectern.operators.candidates import GENERATORS
from lectern.operators.findings import finding
from lectern.operators.registry import CHECKS
from lectern.operators.sieves import COMMON, SIEVES

#: The rule of a check that failed, and what stands for a rule's missing text.
FAILED_CHECK, NO_TEXT = "LD-00", "(not in registry)"
FAILED_GENERATOR = "GEN-ERROR"
_AT_ONCE = 4  # checks that run at a time


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; on one machine a temporary one will do."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` from a table; where they cannot be made, as they are, so that each part that asks for them fails by itself."""
    spark = rows.sparkSession
    folder = run_folder(spark, name)
    try:
        rows.write.parquet(folder)
    except PySparkException:
        return rows
    return spark.read.schema(rows.schema).parquet(folder)


def stored(c: Corpus, *relations: str) -> Corpus:
    """``c`` with its parsed documents and the named relations of it in tables, so that operators do not make them again.

    The table of documents has as many files as they have partitions, two for each
    core at least.
    """
    spark = c.docs.sparkSession
    folder = run_folder(spark, "parsed")
    spread = max(c.docs.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)
    dealt = Corpus(c.docs.repartition(spread))
    seen = dealt.parsed.withColumn("marks", marks("lines", list(SIEVES.values())))
    seen = seen.withColumn("any_mark", F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m)))
    seen.write.parquet(folder)
    again = Corpus(c.docs)
    again.__dict__["parsed"] = spark.read.schema(seen.schema).parquet(folder)
    again.sieves, again.common = {name: k for k, name in enumerate(SIEVES)}, COMMON
    for name in relations:
        wide = {"every_line": "marked_line", "sectioned": "marked_section"}.get(name, name)
        again.__dict__[wide] = _kept(getattr(again, wide), name)
    return again


def _each(c: Corpus, parts: Iterable[tuple[str, Callable[[], DataFrame]]], failed: Callable[[str], DataFrame], name: str) -> DataFrame:
    spark = c.docs.sparkSession
    folder = run_folder(spark, name)

    def run(part: str, make: Callable[[], DataFrame]) -> None:
        try:
            make().write.parquet(f"{folder}/part={part}")
        except PySparkException:
            failed(part).write.mode("overwrite").parquet(f"{folder}/part={part}")

    with ThreadPoolExecutor(_AT_ONCE) as pool:
        for done in [pool.submit(run, part, make) for part, make in parts]:
            done.result()
    schema = failed("none").schema
    return spark.read.schema(schema).parquet(folder).select(schema.names)


def sweep(c: Corpus, tiers: tuple[int, ...] = (1, 2), checks: dict | None = None) -> DataFrame:
    """The findings of every check (of ``checks``, if given) of the wanted tiers."""
    c = stored(c, "every_line", "found_line", "items", "links", "tables")
    types = _kept(structure.doc_types(c), "types")
    failed = lambda name: finding(c.docs.withColumn("line_no", F.lit(1)), name, 1, FAILED_CHECK)
    every = _each(c, [(n, lambda k=k: k(c, types)) for n, k in (checks or CHECKS).items()], failed, "findings")
    return every.where(F.col("tier").isin(*tiers))


def sweep_candidates(c: Corpus, generators: dict | None = None) -> DataFrame:
    """The review candidates of every generator, in the order of lines when they are shown."""
    c = stored(c, "every_line", "found_line", "sectioned", "items", "links", "tables")
    made = generators or GENERATORS
    shape = next(iter(GENERATORS.values()))(c).limit(0)

    def failed(name: str) -> DataFrame:
        known = {"line_no": F.lit(1), "rule_id": F.lit(FAILED_GENERATOR), "generator": F.lit(name), "doc_id": F.col("doc_id")}
        return c.docs.select(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.schema])

    return _each(c, [(n, lambda g=g: g(c)) for n, g in made.items()], failed, "candidates")


def with_rule_text(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings with the text of their rule from ``rules(rule_id, rule)``."""
    known = rules.select(F.col("rule_id").alias("_rule_id"), F.col("rule").alias("_rule")).dropDuplicates(["_rule_id"])
    return findings.join(known, F.col("rule_id") == F.col("_rule_id"), "left").withColumn("rule", F.coalesce("_rule", F.lit(NO_TEXT))).drop("_rule_id", "_rule")


def json_reports(findings: DataFrame) -> DataFrame:
    """doc_id, report: a document's findings as JSON, errors first, by line."""
    entry = F.struct("tier", F.coalesce("line_no", F.lit(0)).alias("line"), F.col("rule_id").alias("ruleId"), F.col("check_id").alias("checkId"), "section")
    return findings.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("report"))


def markdown_rollup(rollup: DataFrame) -> DataFrame:
    """place, line: the rollup by rule as the rows of a Markdown table, most findings first."""
    cells = [F.col(c).cast("string") for c in ("rule_id", "check_id", "tier", "findings", "documents")]
    rows = rollup.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"), F.col("findings").alias("_n"), "rule_id", "check_id")
    return rows.select(F.struct((-F.col("_n")).alias("less"), "rule_id", "check_id").alias("place"), "line")
