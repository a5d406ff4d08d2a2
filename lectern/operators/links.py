"""Links between documents: extraction, classes, targets and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import spark
from lectern.functions.relations import HEADING, QUOTE, Corpus, settled
from lectern.functions.scalars import slug, slug_escaped
from lectern.operators.findings import finding

STRICT = spark(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\s*(?:\"[^\"]*\")?\)")
HREF = spark(r"<a\s[^>]*href\s*=\s*\"([^\"]*)\"", ignore_case=True)


def toggled_lines(c: Corpus) -> DataFrame:
    """Lines outside fences where any fence line, of either character, toggles: the link layers' reading."""
    lines = c.docs.select("doc_id", "path", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", "path", (F.col("i") + 1).alias("line_no"), "raw")
    mark = F.regexp_replace("raw", QUOTE, "").rlike(spark(r"^\s*(```|~~~)"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("mark", mark).withColumn("n", F.sum(F.col("mark").cast("int")).over(order)).where("not mark and n % 2 = 0").select("doc_id", "path", "line_no", "raw")


def kind_of(target: Column) -> Column:
    return (
        F.when(target.rlike("(?i)^https?://"), "external").when(target.rlike("(?i)^(mailto|tel|data|javascript):"), "scheme")
        .when(target.startswith("//"), "external").when(target.startswith("#"), "same-page").otherwise("relative")
    )


def unresolvable(url: Column) -> Column:
    """Placeholder hosts that no probe should try."""
    return url.rlike(spark(r"localhost|127\.0\.0\.1|0\.0\.0\.0|[<>]|\$\{|\bexample\.(com|org|net)\b|\byour(site|domain|app|-)").replace("\\z\\{", "\\$\\{"))


def extracted(c: Corpus) -> DataFrame:
    """doc_id, path, line_no, ord, label, target, image, html, kind of every link outside fences and code."""
    scan = toggled_lines(c).withColumn("scan", F.regexp_replace("raw", "`[^`\n]*`", " "))
    some = scan.where(F.col("scan").contains("](") | F.col("scan").rlike("(?i)<a"))
    marked = F.transform(
        F.arrays_zip(*[F.regexp_extract_all("scan", F.lit(STRICT), k).alias(n) for k, n in ((1, "bang"), (2, "label"), (3, "target"))]),
        lambda x: F.struct(x["label"].alias("label"), x["target"].alias("target"), (x["bang"] == "!").alias("image"), F.lit(False).alias("html")),
    )
    tagged = F.transform(F.regexp_extract_all("scan", F.lit(HREF), 1), lambda t: F.struct(F.lit("").alias("label"), t.alias("target"), F.lit(False).alias("image"), F.lit(True).alias("html")))
    rows = some.select("doc_id", "path", "line_no", F.posexplode(F.concat(marked, tagged)).alias("ord", "x"))
    return rows.select("doc_id", "path", "line_no", "ord", "x.*").withColumn("kind", kind_of(F.col("target")))


def link_counts(c: Corpus) -> DataFrame:
    """Links by kind, with images and HTML links counted besides."""
    rows = extracted(c)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.count_if("image").alias("images"), F.count_if("html").alias("html_links"))


def resolved(base: Column, target: Column) -> Column:
    """``target`` relative to the folder of ``base``, with . and .. folded."""
    folder = F.regexp_replace(base, "[^/]*\\z", "")
    whole = F.when(target.startswith("/"), target).otherwise(F.concat(folder, target))
    return F.array_join(F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    ), "/")


def anchors(c: Corpus) -> DataFrame:
    """path, anchor, level: heading slugs in both forms (lowest level wins), named anchors and {#ids} with no level."""
    heads = toggled_lines(c).where(F.col("raw").rlike(HEADING)).select("path", F.regexp_extract("raw", HEADING, 2).alias("text"), F.length(F.regexp_extract("raw", HEADING, 1)).alias("level"))
    slugs = heads.select("path", "level", F.explode(F.array_distinct(F.array(slug(F.col("text")), slug_escaped(F.col("text"))))).alias("anchor"))
    named = F.concat(F.regexp_extract_all("text", F.lit(spark(r"<a\s[^>]*(?:name|id)\s*=\s*\"([^\"]*)\"", ignore_case=True)), 1), F.regexp_extract_all("text", F.lit(r"\{#([^}]+)\}"), 1))
    ids = c.docs.select("path", F.explode(named).alias("anchor"), F.lit(None).cast("int").alias("level"))
    return slugs.select("path", "anchor", "level").union(ids.select("path", "anchor", "level")).groupBy("path", "anchor").agg(F.min("level").alias("level"))


def internal_links(c: Corpus) -> DataFrame:
    """doc_id, line_no, problem: missing-file, unresolvable-anchor, dead-anchor or deep-anchor.

    Targets are files of the corpus; a target that is a folder of it is accepted.
    """
    rows = extracted(c).where(F.col("kind").isin("relative", "same-page"))
    fragment = F.when(F.col("target").contains("#"), F.regexp_extract("target", "#(.*)\\z", 1)).otherwise("")
    file = F.regexp_replace(F.regexp_extract("target", r"^([^#]*)", 1), r"\?.*\z", "")
    rows = settled(rows.select("doc_id", "path", "line_no", "ord", "kind", file.alias("file"), F.coalesce(F.try_url_decode(F.replace(fragment, F.lit("+"), F.lit("%2B"))), fragment).alias("fragment")))
    rows = rows.withColumn("to", F.when(F.col("file") == "", F.array_join(F.array_remove(F.split("path", "/"), ""), "/")).otherwise(resolved(F.col("path"), F.col("file"))))
    files = c.docs.select(F.array_join(F.array_remove(F.split("path", "/"), ""), "/").alias("to")).distinct()
    parts = F.split("to", "/")
    folders = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("to")).distinct().join(files, "to", "left_anti")
    known = files.withColumn("is_file", F.lit(True)).union(folders.withColumn("is_file", F.lit(False)))
    placed = rows.join(known, "to", "left")
    missing = placed.where("is_file is null").select("doc_id", "line_no", "ord", F.lit("missing-file").alias("problem"))
    asks = placed.where("is_file and fragment <> '' and not startswith(fragment, ':~:')")
    there = anchors(c).select(F.array_join(F.array_remove(F.split("path", "/"), ""), "/").alias("to"), F.col("anchor").alias("fragment"), "level", F.lit(True).alias("found"))
    checked = asks.join(there, ["to", "fragment"], "left")
    problem = F.when(F.col("found").isNull(), "dead-anchor").when(F.col("level") > 3, "deep-anchor")
    folder_anchor = placed.where("not is_file and fragment <> ''").select("doc_id", "line_no", "ord", F.lit("unresolvable-anchor").alias("problem"))
    return missing.union(folder_anchor).union(checked.select("doc_id", "line_no", "ord", problem.alias("problem")).where("problem is not null"))


def external_links(c: Corpus, probes: DataFrame, now_ms: int, ttl_ms: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """Links whose url failed in ``probes(url, status, note, at_ms)``, entries older than the TTL ignored.

    Probing itself is another program's work; this joins its table to every link.
    """
    urls = extracted(c).where("kind = 'external'").where(~unresolvable(F.col("target"))).withColumn("url", F.regexp_extract("target", "^([^#]*)", 1))
    fresh = probes.where(F.col("at_ms") >= now_ms - ttl_ms).groupBy("url").agg(F.max_by("status", "at_ms").alias("status"))
    failed = fresh.where("status = 0 or status >= 400")
    return urls.join(failed, "url").select("doc_id", "line_no", "ord", "url", F.when(F.col("status") == 0, "unreachable").otherwise(F.concat(F.lit("http-"), F.col("status").cast("string"))).alias("problem"))


def published_urls(c: Corpus, entries: DataFrame) -> DataFrame:
    """Documents whose declared url has no row in ``entries(url, published)``, or an unpublished one."""
    declared = c.front_matter.where("present").select("doc_id", F.regexp_replace(F.trim(F.col("keys")["url"]), r"^[\"']|[\"']\z", "").alias("url")).where("url <> ''")
    known = entries.groupBy("url").agg(F.max("published").alias("published"))
    return declared.join(known, "url", "left").select("doc_id", "url", F.when(F.col("published").isNull(), "no-cms-entry").when(~F.col("published"), "not-published").alias("problem")).where("problem is not null")


def anchor_heading_level(c: Corpus, deepest: int = 3) -> DataFrame:
    """In-page links to headings deeper than ``deepest``."""
    links = c.links.where("startswith(url, '#') and not startswith(url, '#:~:')")
    at = F.substring("url", 2, 1 << 20)
    links = links.withColumn("anchor", F.coalesce(F.try_url_decode(F.replace(at, F.lit("+"), F.lit("%2B"))), at))
    return finding(links.join(c.headings.where(F.col("level") > deepest).select("doc_id", "anchor"), ["doc_id", "anchor"]), "anchor-heading-level", 1, "C5-08")


#: Words of a label that say nothing of its target.
LABEL_NOISE = "the a an and or of to in on for with your you this that is are be how what see more about guide page docs documentation section".split()


def label_tokens(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(LABEL_NOISE)))


def misleading_labels(c: Corpus) -> DataFrame:
    """Local links whose label shares no word with the target's headings or file name."""
    rows = extracted(c).where(F.col("kind").isin("relative", "same-page")).where("not image and not html")
    fragment = F.when(F.col("target").contains("#"), F.regexp_extract("target", "#(.*)\\z", 1)).otherwise("")
    file = F.regexp_extract("target", r"^([^#?]*)", 1)
    rows = settled(rows.select("doc_id", "line_no", "ord", "label", fragment.alias("fragment"), F.when(file == "", F.array_join(F.array_remove(F.split("path", "/"), ""), "/")).otherwise(resolved(F.col("path"), file)).alias("to")))
    heads = c.headings.join(c.docs.select("doc_id", "path"), "doc_id")
    heads = heads.select(F.array_join(F.array_remove(F.split("path", "/"), ""), "/").alias("to"), "anchor", "level", "text")
    titles = heads.where("level = 1").groupBy("to").agg(F.flatten(F.collect_list(label_tokens(F.col("text")))).alias("title"))
    named = heads.groupBy("to", F.col("anchor").alias("fragment")).agg(F.flatten(F.collect_list(label_tokens(F.col("text")))).alias("heading"))
    joined = rows.join(titles, "to", "left").join(named, ["to", "fragment"], "left")
    own = label_tokens(F.col("label"))
    base = label_tokens(F.regexp_replace(F.element_at(F.split("to", "/"), -1), r"\.md\z", ""))
    empty = F.array().cast("array<string>")
    told = F.concat(F.coalesce("title", empty), F.coalesce("heading", empty), base, label_tokens(F.col("fragment")))
    return joined.where((F.size(own) > 0) & (F.size(told) > 0) & ~F.arrays_overlap(own, told)).select("doc_id", "line_no", "ord", "label", "to")
