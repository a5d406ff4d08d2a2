"""The findings relation that every check returns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "line_no", "tier", "rule_id", "check_id", "section"]


def finding(rows: DataFrame, check_id: str, tier: int | Column, rule: str | Column, line: str | Column | None = "line_no", section: str | Column | None = None) -> DataFrame:
    as_col = lambda x: F.lit(x) if isinstance(x, (int, str)) else x
    at = F.lit(None).cast("int") if line is None else (F.col(line) if isinstance(line, str) else line).cast("int")
    where = F.lit(None).cast("string") if section is None else (F.col(section) if isinstance(section, str) else section)
    return rows.select("doc_id", at.alias("line_no"), as_col(tier).cast("int").alias("tier"), as_col(rule).alias("rule_id"), F.lit(check_id).alias("check_id"), where.alias("section"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
