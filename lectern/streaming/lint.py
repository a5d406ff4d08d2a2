"""Linting of documents as they arrive.

The checks of lines need one document at a time, so they run unchanged on each
micro-batch; findings are appended by batch, and a batch that is run again
overwrites its own folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.functions.relations import Corpus
from lectern.operators.findings import union
from lectern.operators.registry import CHECKS
from lectern.operators.structure import doc_types

SCHEMA = "doc_id long, path string, text string"


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of documents as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def batch_writer(names: list[str], out: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        c = Corpus(batch)
        types = doc_types(c)
        union([CHECKS[n](c, types) for n in names]).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def lint_stream(docs: DataFrame, names: list[str], out: str, checkpoint: str):
    """Start linting a stream of documents; stops when what is there has been read."""
    return docs.writeStream.foreachBatch(batch_writer(names, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fresh_probes(probes: DataFrame, days: int = 7) -> DataFrame:
    """A stream of link probes (url, status, at) with one row per url within ``days``."""
    return probes.withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(["url"])
