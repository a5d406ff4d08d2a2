"""Structure checks of API reference pages: method pages, class pages and usage guides.

The kind of a page follows from its file name.  Completeness checks compare the
pages of a folder with the links of its index, by full outer joins on folder and
name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import spark
from lectern.functions.relations import Corpus, settled
from lectern.functions.scalars import strip
from lectern.operators.findings import finding, union
from lectern.operators.links import resolved

#: Keys, columns and sections that pages must have.
KEYS = ["uid", "seo_title", "seo_description"]
PARAMETERS = ["Name", "Type", "Required", "Default", "Description"]
CONSTRUCTOR = ["Name", "Type", "Description"]
METHOD_SECTIONS = ["Instance State", "Validation", "Behavior", "Example"]
GUIDE_SECTIONS = ["Minimum Working Example", "SDK Structure", "Class Overview", "Task Index", "Key Usage Patterns", "SDK-Wide Notes", "SDK Limitations"]
CLASS_COLUMNS = ["Class", "Role", "Accessed via"]
TASK_COLUMNS = ["Task", "Start here", "Class"]
LIMIT_COLUMNS = ["Capability", "Supported", "Notes / Alternative"]
NOTE_COLUMNS = ["Concern", "Behavior", "Default when unset"]
FORBIDDEN = [
    "installation", "install", "installing", "setup", "prerequisites", "authentication", "quickstart", "quick start", "methods", "common questions", "faq",
    "frequently asked questions", "additional resources", "additional resource",
]
INSTALL = r"\b(?:npm|yarn|pnpm)\s+(?:install|add)\b|\bpip\s+install\b|\bdotnet\s+add\s+package\b|\bgem\s+install\b|\bcomposer\s+require\b"
LINKED = r"\[[^\]]+\]\([^)]+\)"


def words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def pages(c: Corpus) -> DataFrame:
    """Parsed documents with kind (class, guide, method), name (file without .md) and folder."""
    parts = F.split("path", "/")
    file = F.element_at(parts, -1)
    kind = F.when(file == "class_reference.md", "class").when(file.rlike(r"^usage[_-]guide\.md\z"), "guide").otherwise("method")
    return c.parsed.select("*", kind.alias("kind"), F.regexp_replace(file, r"\.md\z", "").alias("name"), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/").alias("folder"))


def _of(rows: DataFrame, rule: str, tier: int, line: str | Column | None = "line_no") -> DataFrame:
    names = {
        "AR-01": "front-matter-api-ref", "UG-01": "front-matter-api-ref", "AR-02": "api-ref-heading-levels", "UG-02": "api-ref-heading-levels", "AR-03": "api-ref-section-order",
        "UG-03": "api-ref-section-order", "AR-04": "api-ref-returns-line", "AR-05": "api-ref-param-table", "AR-06": "api-ref-additional-resource", "AR-07": "api-ref-trailing-rule",
        "AR-08": "api-ref-method-index-sole-list", "AR-09": "api-ref-index-completeness", "UG-04": "api-ref-class-overview-table", "UG-05": "api-ref-class-overview-completeness",
        "UG-06": "api-ref-task-index", "UG-08": "api-ref-token-type-warning", "UG-09": "api-ref-before-you-begin", "UG-10": "api-ref-usage-guide-scope",
        "UG-11": "api-ref-usage-patterns", "UG-12": "api-ref-sdk-limitations", "UG-13": "api-ref-sdk-wide-notes",
    }
    return finding(rows, names[rule], tier, rule, line)


def front_matter(c: Corpus) -> DataFrame:
    """Exactly three keys; titles filled on class pages, both fields on usage guides."""
    rows = c.front_matter.join(pages(c).select("doc_id", "kind"), "doc_id")
    rule = F.when(F.col("kind") == "guide", "UG-01").otherwise("AR-01")
    had = F.map_keys("keys")
    off = F.concat(F.array_except(words(KEYS), had), F.array_except(had, words(KEYS)))
    some = rows.where("present")
    blank = lambda k: F.trim(F.regexp_replace(F.coalesce(F.col("keys")[k], F.lit("")), '^"|"\\z', "")) == ""
    one = lambda df, tier: finding(df, "front-matter-api-ref", tier, rule, F.lit(1))
    guide = some.where("kind = 'guide'")
    return union([
        one(rows.where("not present"), 1), one(some.select("doc_id", "kind", F.explode(off)), 1),
        *[one(guide.where(F.array_contains(had, k) & blank(k)), 1) for k in ("seo_title", "seo_description")],
        one(some.where("kind = 'class'").where(blank("seo_title")), 2),
    ])


def heading_levels(c: Corpus) -> DataFrame:
    p = pages(c).select("doc_id", "kind", "name", "headings")
    level = lambda n: F.filter("headings", lambda h: h["level"] == n)
    p = settled(p.select("*", level(1).alias("h1"), level(3).alias("h3"), F.coalesce(F.get("headings", F.lit(0))["line"], F.lit(1)).alias("top")))
    each = p.select("doc_id", "kind", "h1", F.explode("headings").alias("h"))
    guide, cls, method = (p.where(F.col("kind") == k) for k in ("guide", "class", "method"))
    line = F.col("h.line")
    title = F.lower(F.get("h1", F.lit(0))["text"])
    return union([
        _of(guide.where(F.size("h1") != 1), "UG-02", 1, "top"),
        _of(guide.where((F.size("h1") == 1) & ~F.get("h1", F.lit(0))["text"].rlike(spark(r"API Reference\s*$", True))), "UG-02", 1, F.get("h1", F.lit(0))["line"]),
        _of(each.where("kind = 'guide' and h.level > 3"), "UG-02", 1, line),
        _of(each.where("kind = 'guide' and h.level = 2").where((F.size("h1") == 1) & (F.lower("h.text") == title)), "UG-02", 2, line),
        _of(cls.where(F.size("h1") != 1), "AR-02", 1, "top"), _of(each.where("kind = 'class' and h.level > 2"), "AR-02", 1, line),
        _of(method.where(F.size("h3") != 1), "AR-02", 1, "top"),
        _of(method.where((F.size("h3") == 1) & (F.get("h3", F.lit(0))["text"] != F.col("name"))), "AR-02", 1, F.get("h3", F.lit(0))["line"]),
        _of(each.where("kind = 'method' and h.level < 3"), "AR-02", 1, line),
    ])


def section_order(c: Corpus) -> DataFrame:
    """Required sections are there, and first occurrences stand in the expected order."""

    def ordered(kind: str, level: int, names: list[str], optional: str, rule: str) -> list[DataFrame]:
        heads = F.filter("headings", lambda h: h["level"] == level)
        p = settled(pages(c).where(F.col("kind") == kind).select("doc_id", "body_start", F.transform(heads, lambda h: h["text"]).alias("t")))
        p = settled(p.select("*", F.array_distinct(F.filter("t", lambda t: t.isin(names))).alias("known")))
        need = words([n for n in names if n != optional])
        return [
            _of(p.select("doc_id", "body_start", F.explode(F.array_except(need, F.col("t")))), rule, 1, "body_start"),
            _of(p.where(F.col("known") != F.filter(words(names), lambda n: F.array_contains("known", n))), rule, 1, "body_start"),
        ]

    return union([*ordered("method", 4, METHOD_SECTIONS, "Instance State", "AR-03"), *ordered("guide", 2, GUIDE_SECTIONS, "SDK Limitations", "UG-03")])


def returns_line(c: Corpus) -> DataFrame:
    p = pages(c).where("kind = 'method'").select("doc_id", "body_start")
    told = c.lines.where(strip(F.col("raw")).rlike(spark(r"^\*\*Returns:\*\*\s+(.+)$"))).groupBy("doc_id").agg(
        F.min("line_no").alias("line_no"), F.min_by(strip(F.regexp_extract(strip(F.col("raw")), spark(r"^\*\*Returns:\*\*\s+(.+)$"), 1)), "line_no").alias("body"))
    rows = p.join(told, "doc_id", "left")
    shaped = F.col("body").rlike(spark(r"^[A-Za-z][\w.<>\[\]]*(\s+or\s+[A-Za-z][\w.<>\[\]]*)*\.\s+\S").replace("[\\w.<>\\[\\]]", r"[\w.<>\[\]]"))
    return union([
        _of(rows.where("line_no is null"), "AR-04", 1, "body_start"), _of(rows.where("line_no is not null").where(~shaped), "AR-04", 1),
        _of(rows.where("line_no is not null").where(shaped & ~F.col("body").endswith(".")), "AR-04", 2),
    ])


def parameter_tables(c: Corpus) -> DataFrame:
    rows = c.tables.join(pages(c).select("doc_id", "kind"), "doc_id")
    exact = lambda names: F.col("header") == words(names)
    first = F.get("header", F.lit(0))
    cls = rows.where("kind = 'class'").where((first == "Name") & ~exact(CONSTRUCTOR) & ~exact(PARAMETERS))
    own = rows.where("kind = 'method'").where((first == "Name") | F.array_contains("header", "Required"))
    cells = own.where(exact(PARAMETERS)).select("doc_id", "start_line", F.posexplode("rows").alias("k", "row"))
    default = F.coalesce(F.trim(F.get("row", F.lit(3))), F.lit(""))
    return union([_of(cls, "AR-05", 2, "start_line"), _of(own.where(~exact(PARAMETERS)), "AR-05", 1, "start_line"), _of(cells.where((default == "") | default.rlike("[—–]")), "AR-05", 1, F.col("start_line") + 2 + F.col("k"))])


def additional_resource(c: Corpus) -> DataFrame:
    p = settled(pages(c).where("kind = 'method'").select("doc_id", "headings", "lines", F.get(F.filter("headings", lambda h: (h["level"] == 4) & (h["text"] == "Validation")), F.lit(0)).alias("v")).where("v is not null"))
    stop = F.coalesce(F.get(F.filter("headings", lambda h: h["line"] > F.col("v.line")), F.lit(0))["line"] - 1, F.size("lines"))
    found = F.get(F.filter(F.transform(F.sequence(F.col("v.line"), F.greatest(stop, F.col("v.line"))), lambda n: F.struct(n.alias("line"), F.get("lines", n - 1).alias("text"))), lambda x: x["text"].rlike("Additional Resources?:")), F.lit(0))
    rows = settled(p.select("doc_id", F.col("v.line").alias("at"), found.alias("x")))
    n = F.regexp_count("x.text", F.lit(r"\]\("))
    plural = F.col("x.text").contains("Additional Resources:")
    return union([_of(rows.where("x is null"), "AR-06", 2, "at"), _of(rows.where(((n == 1) & plural) | ((n > 1) & ~plural)), "AR-06", 2, F.col("x.line"))])


def trailing_rule(c: Corpus) -> DataFrame:
    """Method pages end in a rule, others do not."""
    said = F.filter(F.transform("lines", lambda s, i: F.struct((i + 1).alias("line"), strip(s).alias("text"))), lambda x: x["text"] != "")
    rows = settled(pages(c).select("doc_id", "kind", said.alias("said")))
    last = F.get("said", F.size("said") - 1)
    ruled = F.coalesce(last["text"] == "---", F.lit(False))
    return _of(rows.where((F.col("kind") == "method") != ruled), "AR-07", 2, F.coalesce(last["line"], F.lit(0)))


def method_index(c: Corpus) -> DataFrame:
    p = pages(c).where("kind = 'class'")
    h2 = F.filter("headings", lambda h: h["level"] == 2)
    m = F.get(F.filter(h2, lambda h: F.lower(h["text"]) == "methods"), F.lit(0))
    rows = settled(p.select("doc_id", "body_start", "lines", "headings", m.alias("m"), F.exists(h2, lambda h: h["text"].rlike("(?i)method index")).alias("has")))
    stop = F.coalesce(F.get(F.filter("headings", lambda h: h["line"] > F.col("m.line")), F.lit(0))["line"] - 1, F.size("lines"))
    body = F.slice("lines", F.col("m.line") + 1, F.greatest(stop - F.col("m.line"), F.lit(0)))
    listed = F.exists(body, lambda s: s.rlike(spark(r"^\s*([-*+]|\d+\.)\s|\]\([^)]*methods/[^)]*\.md")))
    return union([_of(rows.where("m is not null").where(listed), "AR-08", 1, F.col("m.line")), _of(rows.where("not has"), "AR-08", 1, "body_start")])


def index_completeness(c: Corpus) -> DataFrame:
    """Methods of a class folder against the links and table rows of its class page; dead .md links."""
    p = pages(c).select("doc_id", "kind", "name", "folder", "body_start", "path")
    cls = p.where("kind = 'class'").select("doc_id", "folder", "body_start")
    disk = p.where(F.col("folder").rlike("/methods\\z")).select(F.regexp_replace("folder", "/methods\\z", "").alias("folder"), "name").distinct().withColumn("on_disk", F.lit(True))
    links = c.links.join(cls, "doc_id").select("doc_id", "folder", F.regexp_extract("url", r"^methods/([^/]+)\.md\z", 1).alias("name")).where("name <> ''").groupBy("doc_id", "folder", "name").agg(F.count(F.lit(1)).alias("n"))
    have = cls.join(disk, "folder").select("doc_id", "folder", "name", "body_start")
    unlinked = have.join(links.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    classed = cls.join(disk.select("folder").distinct(), "folder", "left_semi")
    gone = links.join(disk, ["folder", "name"], "left_anti").join(classed.select("doc_id", "body_start"), "doc_id")
    rows = c.tables.where(F.array_contains("header", "Method Name")).join(cls, "doc_id").select("doc_id", "body_start", F.explode("rows").alias("row"))
    names = rows.select("doc_id", "body_start", F.regexp_extract(F.get("row", F.lit(0)), r"\[[^\]]+\]\(methods/([^)]+)\.md\)", 1).alias("name")).where("name <> ''")
    twice = names.groupBy("doc_id", "body_start", "name").count().where("count > 1").join(classed.select("doc_id"), "doc_id", "left_semi")
    files = c.docs.select(F.array_join(F.array_remove(F.split("path", "/"), ""), "/").alias("to")).distinct()
    relative = c.links.where(F.col("url").endswith(".md") & ~F.col("url").rlike("^(https?:)?//")).join(c.docs.select("doc_id", "path"), "doc_id").withColumn("to", resolved(F.col("path"), F.regexp_extract("url", "^([^#]*)", 1)))
    dead = relative.join(files, "to", "left_anti")
    return union([_of(unlinked, "AR-09", 1, "body_start"), _of(gone, "AR-09", 1, "body_start"), _of(twice, "AR-09", 1, "body_start"), _of(dead, "AR-09", 1)])


def _guide_section(c: Corpus, name: str) -> DataFrame:
    h = F.get(F.filter("headings", lambda x: (x["level"] == 2) & (F.lower(x["text"]) == name.lower())), F.lit(0))
    return pages(c).where("kind = 'guide'").select("doc_id", h.alias("h")).where("h is not null").select("doc_id", F.col("h.line").alias("line"), F.col("h.end_line").alias("end_line"), F.col("h.text").alias("section"))


def _guide_table(c: Corpus, name: str, columns: list[str], rule: str, faults: list[tuple[Callable[[Callable[[int], Column]], Column], int]], tier: int = 1, need_rows: bool = False) -> DataFrame:
    from lectern.operators.structure import first_table

    tabled = first_table(c, _guide_section(c, name))
    some = tabled.where("start_line is not null")
    good = some.where(F.col("header") == words(columns))
    cells = good.select("doc_id", "start_line", F.posexplode("rows").alias("k", "row"))
    cell = lambda i: F.coalesce(F.trim(F.get("row", F.lit(i))), F.lit(""))
    parts = [_of(tabled.where("start_line is null"), rule, 1, "line"), _of(some.where(F.col("header") != words(columns)), rule, 1, "start_line")]
    parts += [_of(cells.where(bad(cell)), rule, t, F.col("start_line") + 2 + F.col("k")) for bad, t in faults]
    if need_rows:
        parts.append(_of(good.where(F.size("rows") == 0), rule, tier, "start_line"))
    return union(parts)





def class_overview(c: Corpus) -> DataFrame:
    return _guide_table(c, "Class Overview", CLASS_COLUMNS, "UG-04", [
        (lambda cell: (cell(0) != "") & ~cell(0).rlike(LINKED), 1), (lambda cell: (cell(2) != "") & ~cell(2).contains("`"), 2),
    ])


def task_index(c: Corpus) -> DataFrame:
    return _guide_table(c, "Task Index", TASK_COLUMNS, "UG-06", [
        (lambda cell: (cell(1) != "") & ~cell(1).rlike(LINKED), 1), (lambda cell: (cell(0) != "") & cell(0).rlike(spark(r"^\S*(?:tion|ment|ing)\b", True)), 2),
    ])


def wide_notes(c: Corpus) -> DataFrame:
    return _guide_table(c, "SDK-Wide Notes", NOTE_COLUMNS, "UG-13", [(lambda cell: (cell(2) == "") | cell(2).rlike("[—–]"), 1)])


def limitations(c: Corpus) -> DataFrame:
    return _guide_table(c, "SDK Limitations", LIMIT_COLUMNS, "UG-12", [(lambda cell: cell(2) == "", 2)], need_rows=True)


def usage_patterns(c: Corpus) -> DataFrame:
    s = _guide_section(c, "Key Usage Patterns")
    heads = s.join(c.headings.where("level = 3").select("doc_id", "line_no", "text"), "doc_id", "left").withColumn("inside", F.coalesce((F.col("line_no") > F.col("line")) & (F.col("line_no") <= F.col("end_line")), F.lit(False)))
    few = heads.groupBy("doc_id", "line").agg(F.count_if("inside").alias("n")).where("n < 3")
    return union([_of(few, "UG-11", 2, "line"), _of(heads.where("inside").where(F.col("text").rlike(spark(r"^(?:example|examples|basic usage|usage|sample|code sample)\b", True))), "UG-11", 2)])


def token_warning(c: Corpus) -> DataFrame:
    s = _guide_section(c, "SDK-Wide Notes")
    told = s.join(c.outside.where(F.col("raw").rlike(spark(r"^\s*>\s*\*\*(?:Warning|IMPORTANT)", True)) & F.col("raw").rlike("(?i)token")).select("doc_id", "line_no"), "doc_id").where("line_no between line and end_line")
    return _of(s.join(told.select("doc_id").distinct(), "doc_id", "left_anti"), "UG-08", 2, "line")


def before_you_begin(c: Corpus) -> DataFrame:
    """A block before the first H2 that names where to start, versions and the changelog."""
    p = pages(c).where("kind = 'guide'")
    at = lambda n: F.get(F.filter("headings", lambda h: h["level"] == n), F.lit(0))["line"]
    rows = settled(p.select("doc_id", "lines", "fences", F.coalesce(at(1) + 1, F.col("body_start")).alias("a"), F.coalesce(at(2) - 1, F.size("lines")).alias("b")))
    starts = F.filter(F.sequence(F.col("a"), F.greatest("a", "b")), lambda n: (n <= F.col("b")) & F.coalesce(F.get("lines", n - 1), F.lit("")).rlike(spark(r"^\s*>\s*\*\*Before you begin:\*\*", True)) & ~F.exists("fences", lambda f: (n >= f["start"]) & (n <= f["stop"])))
    rows = settled(rows.select("doc_id", "lines", "a", F.get(starts, F.lit(0)).alias("s")))
    stop = F.coalesce(F.get(F.filter(F.sequence(F.col("s"), F.size("lines") + 1), lambda n: ~F.coalesce(F.get("lines", n - 1), F.lit("")).rlike(spark(r"^\s*>"))), F.lit(0)), F.size("lines") + 1)
    block = settled(rows.where("s is not null").select("doc_id", "s", F.array_join(F.slice("lines", F.col("s"), stop - F.col("s")), " ").alias("t")))
    t = F.col("t")
    return union([
        _of(rows.where("s is null"), "UG-09", 1, "a"),
        _of(block.where(~(t.rlike("(?i)get started") & t.rlike(LINKED))), "UG-09", 2, "s"),
        _of(block.where(~(t.rlike(spark(r"\b(?:requires?|supports?)\b", True)) & t.rlike("[0-9]"))), "UG-09", 2, "s"),
        _of(block.where(~t.rlike(spark(r"\b(?:changelog|release notes)\b", True))), "UG-09", 2, "s"),
    ])


def guide_scope(c: Corpus) -> DataFrame:
    guides = pages(c).where("kind = 'guide'").select("doc_id")
    heads = c.headings.where("level >= 2").where(F.lower("text").isin(FORBIDDEN)).join(guides, "doc_id", "left_semi")
    first = c.lines.where(F.col("raw").rlike(spark(INSTALL, True))).join(guides, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    return union([_of(heads, "UG-10", 2), _of(first, "UG-10", 2)])


def class_completeness(c: Corpus) -> DataFrame:
    """Class folders beside a usage guide against the links of its class overview."""
    p = pages(c).select("doc_id", "kind", "folder", "body_start")
    guides = p.where("kind = 'guide'").select("doc_id", "folder", "body_start")
    disk = p.where("kind = 'class'").select(F.regexp_replace("folder", "/?[^/]*\\z", "").alias("folder"), F.regexp_extract("folder", "([^/]*)\\z", 1).alias("name")).distinct()
    s = _guide_section(c, "Class Overview").select("doc_id", "line", "end_line")
    links = c.links.join(guides, "doc_id").join(s, "doc_id", "left").where("line is null or line_no between line and end_line")
    named = links.select("doc_id", "folder", "body_start", F.regexp_extract("url", r"^([^/]+)/class_reference\.md(?:#.*)?\z", 1).alias("name")).where("name <> ''").groupBy("doc_id", "folder", "body_start", "name").agg(F.count(F.lit(1)).alias("n"))
    unlinked = guides.join(disk, "folder").join(named.select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    return union([_of(unlinked, "UG-05", 1, "body_start"), _of(named.where("n > 1"), "UG-05", 1, "body_start"), _of(named.join(disk, ["folder", "name"], "left_anti"), "UG-05", 1, "body_start")])


API_CHECKS = {
    f.__name__: f
    for f in (
        front_matter, heading_levels, section_order, returns_line, parameter_tables, additional_resource, trailing_rule, method_index, index_completeness, class_overview,
        task_index, wide_notes, limitations, usage_patterns, token_warning, before_you_begin, guide_scope, class_completeness,
    )
}
