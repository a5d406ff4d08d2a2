from __future__ import annotations

from lectern.streaming.lint import arriving, lint_stream


def test_documents_are_linted_once_as_they_arrive(spark, tmp_path):
    schema = "doc_id long, path string, text string"
    spark.createDataFrame([(1, "a.md", "x — y\n")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda: lint_stream(arriving(spark, f"{tmp_path}/in"), ["em_dash_semicolon", "bare_domain"], f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(2, "b.md", "see z.io\n")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = sorted((r.doc_id, r.rule_id) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "C3-05"), (2, "C5-09")]
