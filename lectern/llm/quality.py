"""Quality rules with adaptive thresholds (DataFrame functions only).

Metrics of every document are counted in one pass over its text.  Each
(language, source) group then gets a quantile sketch per metric: counts of
log-linear bins, which merge by addition, so the sketch of a language or of the
corpus is the sum of its groups' sketches.  Fences read from the sketches replace
fixed cutoffs and are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.shared import sized, unused, whole_text, written

#: metric -> (numerator, denominator, scale).  Values are whole numbers.
RATIOS = {
    "word_length": ("word_chars", "n_words", 1000),
    "symbols": ("n_symbols", "n_words", 1000),
    "dup_lines": ("n_dup_lines", "n_lines", 1000),
    "repeats": ("n_repeat_words", "n_words", 1000),
}
#: metric -> (inner percentile, outer percentile, spread): the fence lies ``spread``
#: times their distance beyond the outer one.  Word lengths spread around a middle;
#: the others are mostly zero, so their fences come from the sketch's tail.
FENCES = {"word_length": (25, 75, 3), "symbols": (50, 90, 3), "dup_lines": (50, 99, 1), "repeats": (50, 99, 1)}
#: Metrics that have a lower fence, too, as far below the inner percentile.
TWO_SIDED = frozenset(["word_length"])
#: A group's fence is averaged with the wider group's, which counts as so many documents.
PRIOR = 200
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: Bins per power of two are 2^SUB; a bin is at most 1/128 of its value wide, well
#: below the spread of word lengths.
SUB = 7


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _occurrences(text: Column, chars: str) -> Column:
    total = F.lit(0)
    for c in chars:
        total = total + (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))))
    return total


def _repeat_words(words: Column) -> Column:
    """Words lying in a five-word window whose content occurs twice or more.

    Windows are compared by a chained 64-bit hash.  Only texts in which some
    window occurs again take the second branch.
    """

    def hashes(w):
        window = lambda i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(5)])
        return F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), window)).otherwise(
            F.array().cast("array<bigint>")
        )

    def covered(h):
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda e, k: (F.get(s, k + 1)["x"] == e["x"]) | ((k > 0) & (F.get(s, k - 1)["x"] == e["x"])))
        starts = F.sort_array(F.transform(_let(pairs, twice), lambda e: e["i"]))
        steps = lambda p: F.transform(p, lambda at, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1), at + 5) - at))
        return F.aggregate(_let(starts, steps), F.lit(0), lambda a, x: a + x)

    some = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return _let(words, lambda w: _let(hashes(w), some))


def metrics(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (longs).

    A null text has no words.
    """
    text = whole_text(text)
    spaced = text
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    words = F.array_remove(F.split(spaced, " "), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(words, lambda w: _let(lines, lambda a: F.struct(
        F.size(w).cast("long").alias("n_words"),
        (F.char_length(text) - _occurrences(text, " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
        _occurrences(text, "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
        F.size(a).cast("long").alias("n_lines"),
    )))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def _value(m: Column, metric: str) -> Column:
    top, below, scale = RATIOS[metric]
    return F.floor(m[top] * scale / F.greatest(m[below], F.lit(1))).cast("long")


def bin_of(v: Column) -> Column:
    """Log-linear bin of a whole number >= 0: exact below 2^(SUB+1), then 2^SUB bins per octave."""
    bits = F.length(F.bin(v))
    shift = F.greatest(bits - (SUB + 1), F.lit(0))
    return (shift * (1 << SUB) + v / F.pow(F.lit(2.0), shift)).cast("long")


def bin_top(b: Column) -> Column:
    """The largest value of bin ``b``."""
    shift = F.greatest(F.floor(b / (1 << SUB)) - 1, F.lit(0))
    return ((b - shift * (1 << SUB) + 1) * F.pow(F.lit(2.0), shift) - 1).cast("long")


def sketches(table: DataFrame, m: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Mergeable sketches: (lang, source, metric, bin, n) of the documents that the base rules pass.

    ``m`` names the struct column of ``metrics``.  Counts are summed in each task
    before they move, so a hot source costs no more than others.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bin_of(_value(F.col(m), k)).alias("bin")) for k in RATIOS]))
    long = table.where(~base_failed(F.col(m))).select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("x"))
    return long.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _own_fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, total and the (low, high) that the group's own sketch gives."""
    merged = sketch.groupBy(*keys, "metric", "bin").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(*keys, "metric")  # as many rows as a sketch has bins
    ranked = merged.withColumns({"upto": F.sum("n").over(over.orderBy("bin")), "total": F.sum("n").over(over)})
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, bin_top(F.col("bin"))))
    levels = sorted({q for inner, outer, _ in FENCES.values() for q in (inner, outer)})
    found = ranked.groupBy(*keys, "metric").agg(F.max("total").alias("total"), *[at(q).alias(f"q{q}") for q in levels])
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for k, (inner, outer, spread) in FENCES.items():
        room = spread * (F.col(f"q{outer}") - F.col(f"q{inner}"))
        high = F.when(F.col("metric") == k, F.col(f"q{outer}") + room).otherwise(high)
        if k in TWO_SIDED:
            low = F.when(F.col("metric") == k, F.col(f"q{inner}") - room).otherwise(low)
    return found.select(*keys, "metric", "total", low.alias("low"), high.alias("high"))


def _shrunk(own: DataFrame, wider: DataFrame, keys: list[str], prior: int) -> DataFrame:
    """``own`` fences averaged with those of the ``wider`` groups, weighted by documents."""
    names = {c: f"_w_{c}" for c in (*keys, "metric", "low", "high")}
    right = wider.select(*[F.col(c).alias(n) for c, n in names.items()])
    same = F.col("metric") == F.col("_w_metric")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(names[k]))
    mean = lambda c: F.floor((F.col("total") * F.col(c) + prior * F.col(f"_w_{c}")) / (F.col("total") + prior)).cast("long").alias(c)
    return own.join(right, same).select(*[c for c in own.columns if c not in ("low", "high")], mean("low"), mean("high"))


def thresholds(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source): a struct (low, high) for each metric.

    A language's fences are averaged with the corpus's, which weigh as much as
    ``prior`` documents, and a source's with its language's; so a small group
    follows the wider one and a large one itself, with no switch between.
    """
    whole = _own_fences(sketch, [])
    lang = _shrunk(_own_fences(sketch, ["lang"]), whole, [], prior)
    fine = _shrunk(_own_fences(sketch, ["lang", "source"]), lang, ["lang"], prior)
    return fine.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == k, F.struct("low", "high"))).alias(k) for k in RATIOS])


def _verdicts(table: DataFrame, m: str, lang: str, source: str, prior: int) -> DataFrame:
    """``table`` with base_failed and kept, in a struct column named as the last of its columns."""
    fences = sized(written(thresholds(sketches(table, m, lang, source), prior), "quality-fences"))
    names = unused(table.columns, *[f"_fence_{c}" for c in fences.columns])
    right = fences.toDF(*names)
    joined = table.join(right, F.col(lang).eqNullSafe(F.col(names[0])) & F.col(source).eqNullSafe(F.col(names[1])), "left")
    inside = F.lit(True)
    for k, name in zip(fences.columns[2:], names[2:], strict=True):
        value = _value(F.col(m), k)
        ok = value <= F.col(name)["high"]
        if k in TWO_SIDED:
            ok = ok & (value >= F.col(name)["low"])
        inside = inside & F.coalesce(ok, F.lit(True))
    failed = base_failed(F.col(m))
    [verdict] = unused(joined.columns, "_verdict")
    return joined.withColumn(verdict, F.struct(failed.alias("base_failed"), (~failed & inside).alias("kept"))).select(*table.columns, verdict)


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """One row per document: id, counts, base_failed, kept.

    Nulls in language or source form groups of their own; a null or empty text
    fails for having no words.  Repeated rows are judged alike, very long texts are
    counted whole, other columns are not read, an empty table gives an empty
    result.  The slim counts are written once, so texts are read in a single pass.
    """
    slim = docs.select(F.col(id_col), F.col(lang_col).alias("_lang"), F.col(source_col).alias("_source"), metrics(F.col(text_col)).alias("_m"))
    told = _verdicts(written(slim, "quality"), "_m", "_lang", "_source", prior)
    return told.select(F.col(id_col), *[F.col("_m")[c].alias(c) for c in COUNTS], "_verdict.base_failed", "_verdict.kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns, whatever their names.

    Rows are written once with their counts beside them, so every text is counted
    once; texts are not shuffled.  Nulls, empty and very long texts, repeated rows
    and empty tables are treated as in ``quality_verdicts``.
    """
    names = docs.columns
    [m] = unused(names, "_metrics")
    told = _verdicts(written(docs.withColumn(m, metrics(F.col(text_col))), "quality"), m, lang_col, source_col, prior)
    return told.where(F.col(told.columns[-1])["kept"]).select(*names)
