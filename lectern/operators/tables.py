"""Checks of tables and of what stands next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import spark
from lectern.functions.relations import Corpus
from lectern.functions.scalars import broken_cells, containment, real_cells, shingles
from lectern.operators.findings import finding, union
from lectern.operators.structure import first_table, of_type


def table_lines(c: Corpus) -> DataFrame:
    """doc_id, start_line, line_no, raw of every line of every table."""
    rows = c.parsed.select("doc_id", "lines", F.explode("tables").alias("t"))
    return rows.select(
        "doc_id", F.col("t.start").alias("start_line"), F.col("t.stop").alias("end_line"),
        F.posexplode(F.slice("lines", F.col("t.start"), F.col("t.stop") - F.col("t.start") + 1)).alias("k", "raw"),
    ).select("doc_id", "start_line", "end_line", (F.col("start_line") + F.col("k")).alias("line_no"), "raw")


def table_integrity(c: Corpus) -> DataFrame:
    """Unlabelled headers, rows with another number of cells, and pairs broken inside a cell."""
    rows = table_lines(c).withColumn("cells", real_cells("raw"))
    heads = rows.where("line_no = start_line").select("doc_id", "start_line", F.col("cells").alias("head"))
    empty = (F.size("head") > 0) & F.forall("head", lambda h: h == "")
    gaps = F.filter(F.transform("head", lambda h, i: F.when((h == "") & (i > 0), i)), lambda i: i.isNotNull())
    body = rows.where("line_no >= start_line + 2").where(F.col("raw").rlike(spark(r"^\s*\|"))).join(heads, ["doc_id", "start_line"])
    broken = body.withColumn("bad", broken_cells("raw"))
    return union([
        finding(heads.where(empty), "table-integrity", 1, "C2-10", "start_line"),
        finding(heads.where(~empty).select("doc_id", "start_line", F.explode(gaps)), "table-integrity", 1, "C2-10", "start_line"),
        finding(body.where(F.size("cells") != F.size("head")), "table-integrity", 1, "C2-10"),
        finding(broken.select("doc_id", "line_no", F.explode("bad")), "table-integrity", 1, "C2-10"),
    ])


def blocks_after(c: Corpus, window: int = 10) -> DataFrame:
    """Callouts, list items and bold lead-ins within ``window`` lines after a table, up to the next heading."""
    callout = spark(r"^\s*>\s*\*\*(Warning|Note|Tip|Additional Resources?)\s*:\*\*\s*(.*)$")
    item = spark(r"^\s*(?:[-*+]|\d+\.)\s+(.*)$")
    lead = spark(r"^\s*\*\*[^*]+\*\*\s+\S")
    near = c.tables.select("doc_id", "start_line", "rows", F.explode(F.sequence(F.col("end_line") + 1, F.col("end_line") + window)).alias("line_no"))
    lines = near.join(c.only("pipe").outside.select("doc_id", "line_no", "raw"), ["doc_id", "line_no"])
    stop = lines.where(F.col("raw").rlike(spark(r"^#{1,6}\s"))).groupBy("doc_id", "start_line").agg(F.min("line_no").alias("stop"))
    lines = lines.join(stop, ["doc_id", "start_line"], "left").where("stop is null or line_no < stop").where(~F.col("raw").rlike(spark(r"^\s*\|")) & F.col("raw").rlike(spark(r"\S")))
    text = F.when(F.col("raw").rlike(callout), F.regexp_extract("raw", callout, 2)).when(F.col("raw").rlike(item), F.regexp_extract("raw", item, 1)).when(F.col("raw").rlike(lead), F.trim("raw"))
    kind = F.when(F.col("raw").rlike(callout), "callout").when(F.col("raw").rlike(item), "item").otherwise("lead-in")
    return lines.select("doc_id", "start_line", "rows", "line_no", text.alias("text"), kind.alias("kind")).where("text is not null")


def table_restatement(c: Corpus, threshold: float = 0.6) -> DataFrame:
    """Blocks that share most of their three-word shingles with a row of the table above."""
    found = blocks_after(c).withColumn("s", shingles(F.col("text"), 3)).where(F.size("s") > 0)
    hit = F.exists("rows", lambda r: containment(F.col("s"), shingles(F.array_join(r, " "), 3)) >= threshold)
    return finding(found.where(hit), "table-restatement", 2, "C7-04")


def quick_reference(c: Corpus, types: DataFrame) -> DataFrame:
    """Columns of the two reference tables, and section cells that link to anchors."""
    parts = []
    for name, columns, rule in (("Quick Reference", ["use case", "section", "key call"], "C2-04"), ("Quick Decision Guide", ["approach", "key configuration value", "reason"], "C1-02")):
        tabled = first_table(c, c.sections_named([name])).join(types, "doc_id").withColumn("heads", F.transform("header", F.lower))
        want = F.array(*map(F.lit, columns))
        if rule == "C2-04":
            want = F.when(F.col("doc_type") == "cli-module-reference", F.array(F.lit("section"))).otherwise(want)
        title = F.lit(name)
        some = tabled.where("start_line is not null")
        parts += [
            finding(tabled.where("start_line is null"), "quick-reference-table", 1, rule, "line", title),
            finding(some.where(F.size(F.array_except(want, F.col("heads"))) > 0), "quick-reference-table", 1, rule, "start_line", title),
        ]
        if rule == "C2-04":
            at = F.array_position("heads", "section").cast("int") - 1
            cells = some.where(at >= 0).select("doc_id", "start_line", at.alias("at"), F.posexplode("rows").alias("k", "row"))
            bad = cells.where(~F.coalesce(F.get("row", F.col("at")), F.lit("")).rlike(r"\]\(#[^)]+\)"))
            parts.append(finding(bad, "quick-reference-table", 1, "C2-04", F.col("start_line") + F.col("k") + 2, title))
    return union(parts)


def type_mapping_grouping(c: Corpus, types: DataFrame) -> DataFrame:
    """Rows of the type mapping whose old-API cell lists several names."""
    tabled = first_table(c, of_type(c.sections_named(["Type Mapping Reference"]), types, "migration-guide")).where("start_line is not null")
    at = F.get(F.filter(F.transform("header", lambda h, i: F.when(F.lower(h).contains("old api"), i)), lambda i: i.isNotNull()), F.lit(0))
    cells = tabled.select("doc_id", "start_line", at.alias("at"), F.posexplode("rows").alias("k", "row")).where("at is not null")
    return finding(cells.where(F.get("row", F.col("at")).contains(",")), "type-mapping-row-grouping", 2, "MIG-05", F.col("start_line") + F.col("k") + 2, F.lit("Type Mapping Reference"))
