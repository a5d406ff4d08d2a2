"""Exact deduplication by progressive refinement (DataFrame functions only).

Level 1 groups rows by text length, level 2 groups what shares a length by a
hash of a prefix, level 3 hashes the full text of what shares both.  Text is
never shuffled: every level moves only lengths, hashes and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.shared import is_small, sized, unused, whole_text, written

_KEYS = ["_len", "_prefix"]


def _keyed(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(
        F.col(id_col).alias("_id"),
        text.alias("_text"),
        F.octet_length(text).alias("_len"),
        F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix"),
    )


def surviving_groups(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """(_len, _prefix) pairs held by more than one row, after levels 1 and 2."""
    keyed = _keyed(docs, id_col, text_col, prefix_chars)
    # Few lengths come twice, so they are broadcast and no length is hot.
    lengths = sized(written(keyed.groupBy("_len").count().where("count > 1").select("_len"), "dedup-lengths"))
    groups = keyed.select(*_KEYS).join(lengths, "_len", "left_semi").groupBy(*_KEYS).count().where("count > 1")
    return written(groups.select(*_KEYS, F.lit(True).alias("_open")), "dedup-open")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Rows are equal when their texts are identical byte for byte; a null text
    counts as empty.  Of equal texts the row with the largest id stays; a null
    id ranks below every other.  Rows that repeat the same id and text count as
    copies of each other, exactly one of them is kept.  Other columns of the
    input are ignored, so clashing names do no harm.  An empty table gives an
    empty result.

    Surviving groups are broadcast while they are small (``sized``); beyond that
    they are joined by a shuffle of lengths and hashes (``broadcast_bytes`` changes the
    plan and never the rows).  Long texts are hashed
    whole and not moved.
    """
    open_groups = surviving_groups(docs, id_col, text_col, prefix_chars)
    # The query returns every text's hash, so all rows are hashed here.
    slim = _keyed(docs, id_col, text_col, prefix_chars).withColumn("_sha", F.sha2("_text", 256)).drop("_text")
    marked = slim.join(sized(open_groups, broadcast_bytes), _KEYS, "left")
    alone = marked.where("_open is null").select(
        F.col("_id").alias(id_col),
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )
    # By id first: a hot group is spread over its ids before it is counted.
    each = marked.where("_open").groupBy("_len", "_sha", "_id").agg(F.count(F.lit(1)).alias("_n"))
    groups = each.groupBy("_len", "_sha").agg(
        F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size")
    )
    shared = (
        each.join(groups, ["_len", "_sha"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
        .select(
            F.col("_id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_k") == 1)).alias("kept"),
            F.col("_sha").alias("text_sha256"),
        )
    )
    return alone.unionByName(shared)


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` that exact deduplication keeps, with all their columns.

    Full texts are hashed only in the groups that share length and prefix.  Rows
    repeating one id are told apart by their text; of rows that repeat both id and
    text one stays.  A null text counts as empty, a null id ranks below every
    other, columns may have any names, an empty table gives an empty result.
    """
    names = docs.columns
    length, prefix, opened, own, gid = unused(names, "_len", "_prefix", "_open", "_sha", "_gid")
    groups = surviving_groups(docs, id_col, text_col, prefix_chars).toDF(length, prefix, opened)
    text = whole_text(text_col)
    keyed = docs.withColumns({length: F.octet_length(text), prefix: F.xxhash64(F.substring(text, 1, prefix_chars))})
    # Beyond a broadcast the groups would move the texts, so all are hashed then.
    marked = keyed.join(F.broadcast(groups), [length, prefix], "left") if is_small(groups, broadcast_bytes) else keyed.withColumn(opened, F.lit(True))
    hashed = marked.withColumn(own, F.when(F.col(opened), F.unhex(F.sha2(text, 256))))
    each = hashed.where(F.col(own).isNotNull()).groupBy(F.col(id_col).alias("i"), F.col(own).alias("h"), F.col(length).alias("l")).agg(F.count(F.lit(1)).alias("n"))
    each = written(each, "dedup-each")
    stays = each.groupBy("h", "l").agg(F.max("i").alias("stays"), F.sum("n").alias("m")).where("m > 1").select(F.col("h").alias("_h"), F.col("l").alias("_l"), "stays")
    dropped = each.join(stays, (F.col("h") == F.col("_h")) & (F.col("l") == F.col("_l"))).withColumn("stay", F.col("i").eqNullSafe(F.col("stays")))
    goes = written(dropped.where("not stay").select("i", "h"), "dedup-goes")
    repeats = written(dropped.where("stay and n > 1").select("i", "h"), "dedup-repeats")
    right = unused(hashed.columns, "_goes_id", "_goes_sha")
    match = F.col(id_col).eqNullSafe(F.col(right[0])) & (F.col(own) == F.col(right[1]))
    rest = hashed.join(sized(goes, broadcast_bytes).toDF(*right), match, "left_anti")
    if repeats.isEmpty():
        return rest.select(*names)
    repeats = sized(repeats, broadcast_bytes).toDF(*right)
    single = rest.join(repeats, match, "left_anti").select(*names)
    folded = rest.join(repeats, match, "left_semi").groupBy(F.col(id_col).alias(gid), own).agg(*[F.first(c).alias(c) for c in names if c != id_col])
    return single.unionByName(folded.withColumnRenamed(gid, id_col).select(*names))
