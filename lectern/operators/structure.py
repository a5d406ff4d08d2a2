"""Checks of front matter, headings, sections, lists and fences."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import SPACE, spark
from lectern.functions.relations import Corpus, children, own_lines, settled, text_of
from lectern.functions.scalars import strip, word_count
from lectern.operators.findings import finding, union
from lectern.operators.structure_data import SECTION_ORDER


CLI_TYPES = ["cli-command-reference", "cli-task-runbook", "cli-module-reference", "cli-plugin-guide"]
TYPES = list(SECTION_ORDER)
_WORDS = re.compile("[a-z0-9]+")


# ---- document types -----------------------------------------------------------------


def doc_types(c: Corpus, cli_names: tuple[str, ...] = ("cli",)) -> DataFrame:
    """doc_id, doc_type, is_cli: declared in front matter, else the first rule that fits."""
    facts = c.parsed.join(c.front_matter.select(F.col("doc_id").alias("_d"), "keys"), F.col("doc_id") == F.col("_d"), "left").select(
        "doc_id",
        F.regexp_replace(strip(F.col("keys")["doc_type"]), r"^[\"']|[\"']\z", "").alias("declared"),
        F.lower(F.coalesce(F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))["text"], F.lit(""))).alias("title"),
        F.transform("headings", lambda h: F.lower(h["text"])).alias("names"),
        F.transform(F.filter("headings", lambda h: h["level"] == 2), lambda h: h["text"]).alias("h2"),
        c.first_section(["Overview"]).alias("o"), "headings", "lines",
    )
    facts = settled(facts)
    facts = settled(facts.select("*", F.when(F.col("o").isNotNull(), F.lower(text_of(own_lines(F.col("o"), F.col("headings")), F.col("lines")))).otherwise("").alias("overview")).drop("o", "headings", "lines"))
    title, overview = F.col("title"), F.col("overview")
    has = lambda *names: F.arrays_overlap("names", F.array(*[F.lit(n.lower()) for n in names]))
    like = lambda col, p: col.rlike(spark(p))
    is_cli = like(title, rf"\b(?:{'|'.join(cli_names)})\b") | has("Commands")
    migrating = has("Type Mapping Reference", "Pre-Upgrade Checklist")
    count = lambda p: F.size(F.filter("h2", lambda h: F.trim(h).rlike(spark(p, ignore_case=True))))
    spine = (count(r"^steps? for execution$") > 0) | (count(r"^step \d+\s*:") >= 2) | ((count(r"^steps to\b") >= 2) & (count(r"^(?:commands|options)$") == 0))
    cli_type = (
        F.when(like(title, r"^install the cli\b"), "setup-guide")
        .when(like(title, r"\basset scanning\b|\bcs assets\b|^branches \| migration use cases$"), "feature-doc")
        .when(like(title, r"\blimitations\b|\bconfiguration reference\b|\bsupported features\b"), "cli-module-reference")
        .when(like(title, r"^creat(e|ing) custom cli plugins\b"), "cli-plugin-guide")
        .when(like(title, r"^(migrate|change|update|overwrite|restore|bootstrap|creat(e|ing) custom)\b|\bmigration use cases\b|\bstarter apps\b"), "cli-task-runbook")
        .when(like(title, r"\bplugin\b"), "cli-command-reference")
        .when(spine, "cli-task-runbook")
        .otherwise("cli-command-reference")
    )
    kind = (
        F.when(F.col("declared").isin(TYPES), F.col("declared"))
        .when(title.startswith("get started with") | (has("Role-Based Routing Table") & has("Quick Start")), "getting-started")
        .when(is_cli & ~migrating & (F.size("h2") > 0), cli_type)
        .when(like(title, r"\bmigrat|upgrad") | migrating, "migration-guide")
        .when(like(title, r"^(fetch|configure|add|create|delete|update|list|generate|validate|compare)\b"), "how-to-guide")
        .when(like(overview, r"\binstall|configur.*(environment|sdk|runtime)"), "setup-guide")
        .when(like(overview, r"\bclone|starter|kickstart") | like(title, r"\bclone|starter|kickstart"), "kickstarter")
        .when(has("Commands", "Command Reference") | like(title, r"\bplugin|command\b"), "feature-doc")
        .otherwise("conceptual-guide")
    )
    return facts.select("doc_id", kind.alias("doc_type"), is_cli.alias("is_cli"))


def cli_subjects(types: DataFrame) -> DataFrame:
    return types.where(F.col("doc_type").isin(CLI_TYPES) | F.col("is_cli")).select("doc_id")


def of_type(rows: DataFrame, types: DataFrame, *kinds: str) -> DataFrame:
    return rows.join(types.where(F.col("doc_type").isin(list(kinds))).select("doc_id"), "doc_id", "left_semi")


# ---- front matter ----------------------------------------------------------------------


def front_matter(c: Corpus, types: DataFrame) -> DataFrame:
    rows = c.front_matter.join(types, "doc_id")
    none = finding(rows.where("not present"), "front-matter", 1, "FM-01", F.lit(1))
    bad = finding(rows.where("present").select("doc_id", F.explode("malformed").alias("line_no")), "front-matter", 1, "FM-02")
    cli = F.col("doc_type").isin(CLI_TYPES)
    need = F.when(cli, F.array(*map(F.lit, ("title", "description", "url")))).otherwise(F.array(*map(F.lit, ("seo_title", "seo_description", "url"))))
    need = F.concat(need, F.when(F.col("doc_type") == "migration-guide", F.array(F.lit("version"))).otherwise(F.array().cast("array<string>")))
    had = F.map_keys("keys")
    mirror = cli & F.array_contains(had, "uid") & ~F.array_contains(had, "title")
    other = F.create_map(*[F.lit(x) for x in ("title", "seo_title", "description", "seo_description", "url", "uid")])
    lacking = F.filter(need, lambda k: ~F.array_contains(had, k) & ~(mirror & F.coalesce(F.array_contains(had, other[k]), F.lit(False))))
    gone = rows.where("present").select("doc_id", F.explode(lacking).alias("key"))
    return union([none, bad, finding(gone, "front-matter", 1, F.when(F.col("key") == "version", "MIG-02").otherwise("FM-01"), F.lit(1))])


# ---- sections -----------------------------------------------------------------------------

PSEUDO = ["seo front matter", "page title", "main content"]


def _alternatives(label: str) -> list[str]:
    return [p.strip() for p in re.split(r"\s+or\s+", label.lower().split("(")[0]) if p.strip()]


def _expected() -> list[tuple[str, int, str, bool, list[str]]]:
    """(type, place, section, required, alternatives) of every expected section that has a heading."""
    rows = []
    for kind, sections in SECTION_ORDER.items():
        real = [(s, r) for s, r in sections if s.lower().split("(")[0].strip() not in PSEUDO]
        rows += [(kind, i, s, r.strip().lower().startswith("required"), _alternatives(s)) for i, (s, r) in enumerate(real)]
    return rows


FORBIDDEN = ["quick start", "role-based routing table", "documentation map", "table of contents"]


def section_structure(c: Corpus, types: DataFrame) -> DataFrame:
    """Missing title and sections, sections out of order, and sections that do not belong."""
    spark_session = c.docs.sparkSession
    # One row per type and expected section: about a hundred, so it is broadcast.
    expected = F.broadcast(spark_session.createDataFrame(_expected(), "doc_type string, place int, expected string, required boolean, alternatives array<string>"))
    docs = settled(c.parsed.select("doc_id", "headings", "lines", "fences").join(types, "doc_id"))
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))
    stop = F.coalesce(F.get(F.filter("headings", lambda h: (h["line"] > h1["line"]) & (h["level"] <= 2)), F.lit(0))["line"] - 1, F.size("lines"))
    lede = F.when(
        h1.isNotNull() & (stop > h1["line"]),
        F.array_join(F.filter(F.transform(
            F.filter(F.sequence(h1["line"] + 1, F.greatest(stop, h1["line"] + 1)), lambda n: ~F.exists("fences", lambda f: (n >= f["start"]) & (n <= f["stop"]))), lambda n: F.get("lines", n - 1)),
            lambda s: (strip(s) != "") & ~strip(s).startswith("<!--")), " "),
    ).otherwise("")
    facts = settled(docs.select("doc_id", "doc_type", "is_cli", h1.isNull().alias("untitled"), (F.char_length(strip(lede)) >= 40).alias("lede"), F.filter("headings", lambda h: h["level"] == 2).alias("h2")))
    names = F.transform("h2", lambda h: F.lower(strip(h["text"])))
    fits = lambda name: F.exists("alternatives", lambda a: (name == a) | name.contains(a) | a.contains(name))
    place = F.get(F.filter(F.transform(names, lambda n, i: F.when(fits(n), i)), lambda i: i.isNotNull()), F.lit(0))
    met = facts.join(expected, "doc_type").select("doc_id", "is_cli", "lede", "place", "expected", "required", place.alias("seen"))
    missing = met.where("required and seen is null").where(~(F.col("is_cli") & (F.lower("expected") == "troubleshooting")) & ~(F.col("lede") & F.lower("expected").rlike(spark(r"^overview\b"))))
    order = Window.partitionBy("doc_id").orderBy("seen", "place")
    swapped = met.where("seen is not null").withColumn("before", F.lag("place").over(order)).where("place < before")
    each = facts.select("doc_id", "doc_type", "is_cli", F.explode("h2").alias("h")).select("doc_id", "doc_type", "is_cli", F.col("h.line").alias("line_no"), F.col("h.text").alias("section"), F.lower(strip(F.col("h.text"))).alias("name"))
    start = each.where("doc_type = 'getting-started'").where(F.col("name").isin("theory sections", "theory", "troubleshooting"))
    theory = F.col("name").isin("theory sections", "theory")
    trouble = F.col("name") == "troubleshooting"
    other = each.where("doc_type <> 'getting-started'").where(F.col("name").isin(FORBIDDEN) | ((F.col("doc_type") == "migration-guide") & theory) | (F.col("is_cli") & trouble))
    rule = F.when(theory, "MIG-08").when(F.col("is_cli") & trouble, "CLI-19").otherwise("C1-01")
    return union([
        finding(facts.where("untitled"), "section-structure", 1, "C1-01", None),
        finding(missing, "section-structure", 1, "C1-01", None),
        finding(swapped, "section-structure", 1, "C1-02", None),
        finding(start, "section-structure", 1, F.when(trouble, "RS3-02").otherwise("RS3-01"), section="section"),
        finding(other, "section-structure", 1, rule, section="section"),
    ])


def qa_headers(c: Corpus) -> DataFrame:
    """Headings that ask, outside sections of questions."""
    faq = F.filter("headings", lambda s: F.lower(s["text"]).isin("faq", "frequently asked questions", "common questions"))
    asks = F.filter("headings", lambda h: (h["level"] > 1) & h["text"].endswith("?") & ~F.exists(faq, lambda s: (h["line"] >= s["line"]) & (h["line"] <= s["end_line"])))
    return finding(c.parsed.select("doc_id", F.explode(asks).alias("h")), "qa-headers", 1, "C3-02", F.col("h.line"), F.col("h.text"))


def troubleshooting_format(c: Corpus) -> DataFrame:
    """Entries need a root cause, a resolution, in this order."""
    docs = settled(c.parsed.select("doc_id", "headings", "lines", c.first_section(["Troubleshooting"]).alias("t")).where("t is not null"))
    rows = docs.select("doc_id", "lines", F.explode(children(F.col("t"), F.col("headings"))).alias("h"))
    body = F.array_join(F.slice("lines", F.col("h.line") + 1, F.greatest(F.col("h.end_line") - F.col("h.line"), F.lit(0))), "\n")
    rows = rows.select("doc_id", F.col("h.line").alias("line_no"), F.col("h.text").alias("section"), F.regexp_instr(body, F.lit(r"\*\*Root Causes?\*\*")).alias("cause"), F.regexp_instr(body, F.lit(r"\*\*Resolution\*\*")).alias("fix"))
    parts = [rows.where("cause = 0"), rows.where("fix = 0"), rows.where("cause > 0 and fix > 0 and cause > fix")]
    return union([finding(p, "troubleshooting-format", 1, "C1-05", section="section") for p in parts])


def heading_length(c: Corpus) -> DataFrame:
    """Fragments and dependent openers; headings of more than four words that are no product message."""
    heads = c.headings.where("level > 1")
    t = F.col("text")
    fragment = t.rlike("^[a-z]") & ~t.rlike(spark(r"^(?:[a-z0-9]+[-_][a-z0-9-_]+|[a-z]+\.[a-z]+|npx|npm|node|stdio)\b")) & ~t.rlike(spark(r"^(?:[a-z]+[A-Z][A-Za-z0-9]*|[a-z][\w.]*\(|[a-z][\w-]*$)"))
    opener = t.rlike(spark(r"^(?:And|But|Or|Nor|So|Because|Which|Whereas|Unless|Although|Though)\b")) & t.rlike(f"[{SPACE}]")
    marked = heads.withColumn("odd", fragment | opener)
    long = marked.where(~F.col("odd") & (word_count(F.regexp_replace("text", "`[^`]+`", "X")) > 4))
    output = t.endswith(".") | t.rlike(r"<[A-Z_]+>") | t.rlike(r'"[a-z_]+"|`[a-z_]+`')
    after = next_prose(c.only("long heading"))
    joined = long.join(after, ["doc_id", "line_no"], "left")
    entry = F.coalesce(F.col("next_prose").rlike(spark(r"^\s*\*\*Root Cause\*\*")), F.lit(False))
    return union([finding(marked.where("odd"), "heading-length", 1, "C2-08"), finding(joined.where(~(entry & output)), "heading-length", 2, "C2-07")])


def next_prose(c: Corpus) -> DataFrame:
    """doc_id, line_no, next_prose: the next non-blank line outside fences."""
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    some = F.when(~F.col("in_fence") & F.col("raw").rlike(spark(r"\S")), F.col("raw"))
    return c.every_line.select("doc_id", "line_no", F.first(some, ignorenulls=True).over(ahead).alias("next_prose"))


def heading_uniformity(c: Corpus) -> DataFrame:
    """Only children that name a change otherwise than most others do; ties go to the first seen."""
    docs = c.parsed.select("doc_id", "headings")
    one = F.filter(F.transform("headings", lambda h: children(h, F.col("headings"))), lambda k: (F.size(k) == 1) & k[0]["text"].rlike("(?i)removed|renamed|deprecated|hidden|short character|alias"))
    rows = docs.select("doc_id", F.explode(one).alias("k")).select("doc_id", F.col("k")[0]["line"].alias("line_no"), F.lower(F.col("k")[0]["text"]).alias("name"))
    per = Window.partitionBy("doc_id", "name")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(per)).withColumn("first", F.min("line_no").over(per))
    doc = Window.partitionBy("doc_id")
    rows = rows.withColumn("best", F.max(F.struct("n", -F.col("first"), "name")).over(doc)).withColumn("all", F.count(F.lit(1)).over(doc))
    return finding(rows.where("all >= 2 and best.n >= 2 and name <> best.name"), "heading-uniformity", 2, "C6-06")


SEQUENCE = (
    r"\b(steps?|in this order|in the order|sequence|sequential|follow|following|precedence|order|ranked|ranking|priority|highest|lowest|wins|stages?|phases?|process|flow|"
    r"lifecycle|works|happens|authenticat\w*|first|then|finally)\b"
)
#: Verbs that open a step.
IMPERATIVES = (
    "add adjust apply assign browse call change check choose clear click clone close collapse complete configure confirm connect copy create decrease define delete deploy "
    "disable download drag drop duplicate edit enable ensure enter expand export fetch filter find generate give go grant hover import increase install keep launch list log "
    "modify name navigate note open pause paste pick press publish quote read reconnect refresh register reload remove rename reopen repeat replace request rerun reset restart "
    "restore resume return review revoke rotate run save scroll search select send set share sign start stop submit switch test toggle trigger type unpublish update upload use "
    "validate verify wait"
).split()


def first_word(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "`[^`]*`", " "), r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    return F.lower(F.regexp_extract(strip(F.regexp_replace(plain, "[*_>#]", "")), "^([A-Za-z][A-Za-z-]*)", 1))


def imperative(word: Column) -> Column:
    return word.isin(IMPERATIVES) | (word.startswith("re-") & F.regexp_replace(word, "^re-", "").isin(IMPERATIVES))


def ordered_blocks(c: Corpus, least: int = 2) -> DataFrame:
    """Runs of top-level ordered items at most two lines apart: doc_id, start, stop, n, steps."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    body = c.items.join(c.parsed.select("doc_id", "body_start"), "doc_id").where("ordered and indent = 0 and line_no >= body_start")
    runs = body.withColumn("new", (F.col("line_no") - F.lag("line_no").over(order) > 2).cast("int")).withColumn("run", F.sum(F.coalesce("new", F.lit(0))).over(order))
    return runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("start"), F.max("line_no").alias("stop"), F.count(F.lit(1)).alias("n"), F.sum(imperative(first_word(F.col("text"))).cast("int")).alias("steps")).where(F.col("n") >= least)


def ordered_list_sequence(c: Corpus) -> DataFrame:
    """Numbered lists whose lead-in, heading and items show no order."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    back = order.rowsBetween(-3, -1)
    lead = F.last(F.when(F.col("raw").rlike(spark(r"\S")) & F.col("is_body"), F.col("raw")), ignorenulls=True).over(back)
    leads = c.only("ordered item").every_line.select("doc_id", F.col("line_no").alias("start"), lead.alias("lead"))
    blocks = ordered_blocks(c).where("steps * 2 < n").join(leads, ["doc_id", "start"], "left")
    above = c.parsed.select("doc_id", "headings")
    joined = blocks.join(above, "doc_id")
    title = F.element_at(F.filter("headings", lambda h: h["line"] < F.col("start")), -1)["text"]
    title = F.when(F.exists("headings", lambda h: h["line"] < F.col("start")), title)
    context = F.concat_ws(" ", "lead", title)
    return finding(joined.where(~context.rlike(spark(SEQUENCE, ignore_case=True))), "ordered-list-sequence", 2, "C3-14", F.col("start"))


# ---- within named sections ---------------------------------------------------------------------


def within(rows: DataFrame, sections: DataFrame, line: str = "line_no", first: int = 1) -> DataFrame:
    """Rows on a line of their document's section (after its heading)."""
    s = sections.select(F.col("doc_id").alias("_d"), "line", F.col("end_line").alias("_end"), "section")
    return rows.join(s, (F.col("doc_id") == F.col("_d")) & (F.col(line) >= F.col("line") + first) & (F.col(line) <= F.col("_end"))).drop("_d", "_end")


def bare_links(c: Corpus) -> DataFrame:
    parts = []
    for name, rule in (("Next Steps", "C1-06"), ("Role-Based Routing Table", "RS1-04"), ("Documentation Map", "RS1-04")):
        parts.append(finding(within(c.links.where("bare"), c.sections_named([name])), "bare-links", 1, rule, section=F.lit(name)))
    return union(parts)


def prerequisites_links(c: Corpus) -> DataFrame:
    linked = c.links.select("doc_id", "line_no").distinct()
    items = within(c.items, c.sections_named(["Prerequisites"])).join(linked, ["doc_id", "line_no"], "left_anti")
    return finding(items, "prerequisites-links", 2, "C1-04", section=F.lit("Prerequisites"))


def try_catch(c: Corpus) -> DataFrame:
    code = c.fences.where(F.lower("lang").isin("js", "jsx", "ts", "tsx", "javascript", "typescript"))
    waits = F.col("body").rlike(spark(r"\bawait\b|\.then\s*\(")) & ~F.col("body").rlike(spark(r"\btry\s*\{"))
    return finding(code.where(waits), "try-catch-heuristic", 2, "C4-05", "start_line")


def callout_frequency(c: Corpus) -> DataFrame:
    callout = spark(r"^\s*(\*\*)?(ATTENTION|Required|Note|Additional Resource)(\*\*)?\s*:", ignore_case=True)
    sections = c.headings.where("level = 2").select("doc_id", F.col("line_no").alias("line"), F.col("text").alias("section"), "end_line")
    rows = within(c.outside.where(F.col("raw").rlike(callout)), sections)
    many = rows.groupBy("doc_id", "line", "section").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no")).where("n > 1")
    return finding(many, "callout-frequency", 2, "C2-05", section="section")


def like_pairs(bodies: list[str], n: int = 5) -> list[dict[str, int]]:
    """a, b: places of the lower-cased texts of which two share over half of their n-word shingles."""
    sets = []
    for k, body in enumerate(bodies):
        w = _WORDS.findall(body)
        if len(w) >= n:
            sets.append((k, w))
    if len(sets) < 2:
        return []
    sets = [(k, set(zip(*(w[d:] for d in range(n)), strict=False))) for k, w in sets]
    found = []
    for at, (b, t) in enumerate(sets):
        for a, s in sets[:at]:
            # Sets of which one is at most half of the other share no more than half.
            if 2 * min(len(s), len(t)) > max(len(s), len(t)):
                both = len(s & t)
                if both / (len(s) + len(t) - both) > 0.5:
                    found.append({"a": a, "b": b})
    return found


def duplicate_sections(c: Corpus) -> DataFrame:
    """Pairs of H2 sections of one document whose own bodies share over half of their five-word shingles."""
    several = c.parsed.select("doc_id", "headings", "lines", F.filter("headings", lambda h: h["level"] == 2).alias("h2")).where(F.size("h2") > 1)
    body = lambda h: F.lower(text_of(own_lines(h, F.col("headings")), F.col("lines")))
    docs = settled(several.select("doc_id", F.transform("h2", lambda h: h["line"]).alias("at"), F.transform("h2", body).alias("bodies")))

    def paired(texts: pa.Array) -> pa.Array:
        return pa.array([like_pairs(x) for k in range(0, len(texts), 64) for x in texts.slice(k, 64).to_pylist()], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))

    pairs = docs.select("doc_id", "at", F.arrow_udf(paired, "array<struct<a:int,b:int>>")("bodies").alias("pairs")).select("doc_id", "at", F.explode("pairs").alias("p"))
    return finding(pairs.select("doc_id", F.get("at", F.col("p.b")).alias("l2")), "duplicate-sections", 2, "C7-01", "l2")


def duplicate_links(c: Corpus) -> DataFrame:
    many = c.links.groupBy("doc_id", "url").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no")).where("n > 1")
    return finding(many, "duplicate-links", 2, "C5-04")


def migration_before_after(c: Corpus, types: DataFrame) -> DataFrame:
    docs = settled(of_type(c.parsed, types, "migration-guide").select("doc_id", "headings", "lines", c.first_section(["Main Content"]).alias("m")).where("m is not null"))
    rows = docs.select("doc_id", "lines", F.explode(children(F.col("m"), F.col("headings"))).alias("h"))
    body = F.lower(F.array_join(F.slice("lines", F.col("h.line") + 1, F.greatest(F.col("h.end_line") - F.col("h.line"), F.lit(0))), "\n"))
    lacks = ~body.contains("no prior equivalent") & (~body.rlike(spark(r"\bbefore\b")) | ~body.rlike(spark(r"\bafter\b")))
    return finding(rows.where(lacks), "migration-before-after", 2, "MIG-03", F.col("h.line"), F.col("h.text"))


def quick_start_verification(c: Corpus, types: DataFrame) -> DataFrame:
    items = within(of_type(c.items.where("ordered"), types, "getting-started"), c.sections_named(["Quick Start"]))
    last = items.groupBy("doc_id").agg(F.max_by("text", "line_no").alias("text"), F.max("line_no").alias("line_no"))
    told = F.col("text").rlike(spark(r"\breturns?\b|\byou should see\b|\brunning at\b|\bconfirm|\bverif", ignore_case=True))
    return finding(last.where(~told), "quick-start-verification", 2, "RS2-03", section=F.lit("Quick Start"))


def getting_started(c: Corpus, types: DataFrame) -> DataFrame:
    docs = settled(of_type(c.parsed, types, "getting-started").select(
        "doc_id", "lines", F.filter("headings", lambda h: h["level"] == 2).alias("h2"),
        c.first_section(["Overview"]).alias("o"), c.first_section(["Role-Based Routing Table"]).alias("r"), c.first_section(["Quick Start"]).alias("q"),
    ))
    place = lambda h: F.array_position(F.transform("h2", lambda x: x["line"]), h["line"])
    apart = docs.where("o is not null and r is not null").where((place(F.col("r")) - 1) != F.when(place(F.col("o")) > 0, place(F.col("o")) - 1).otherwise(-1) + 1)
    routing = docs.where("r is not null").select("doc_id", F.col("r.line").alias("line"), F.col("r.end_line").alias("end_line"), F.lit("Role-Based Routing Table").alias("section"))
    heads = F.transform("header", F.lower)
    tabled = first_table(c, routing)
    lacks = F.size(F.array_except(F.array(*map(F.lit, ("i want to...", "i am...", "start here"))), heads)) > 0
    quick = docs.where("q is not null")
    body = F.array_join(F.slice("lines", F.col("q.line"), F.col("q.end_line") - F.col("q.line") + 1), "\n")
    steps = within(c.items.where("ordered"), quick.select("doc_id", F.col("q.line").alias("line"), F.col("q.end_line").alias("end_line"), F.lit("Quick Start").alias("section")))
    counts = steps.groupBy("doc_id", "line", "section").agg(F.count(F.when(F.col("indent") == 0, 1)).alias("top"), F.count(F.lit(1)).alias("n"))
    many = counts.where(F.when(F.col("top") > 0, F.col("top")).otherwise(F.col("n")) > 10)
    return union([
        finding(apart, "getting-started-specific", 1, "RS1-01", F.col("r.line"), F.lit("Role-Based Routing Table")),
        finding(tabled.where("start_line is null"), "getting-started-specific", 1, "RS1-02", "line", "section"),
        finding(tabled.where("start_line is not null").where(lacks), "getting-started-specific", 1, "RS1-02", "start_line", "section"),
        finding(quick.where(~body.rlike("(?i)estimated time:")), "getting-started-specific", 1, "RS2-02", F.col("q.line"), F.lit("Quick Start")),
        finding(many, "getting-started-specific", 1, "RS2-04", "line", "section"),
    ])


def first_table(c: Corpus, sections: DataFrame) -> DataFrame:
    """Each section with its first table, null columns where it has none."""
    found = within(c.tables, sections, "start_line").groupBy("doc_id", "line").agg(F.min_by(F.struct("start_line", "end_line", "header", "rows"), "start_line").alias("t"))
    found = found.select(F.col("doc_id").alias("_d"), F.col("line").alias("_l"), "t.start_line", "t.header", "t.rows")
    return sections.join(found, (F.col("doc_id") == F.col("_d")) & (F.col("line") == F.col("_l")), "left").drop("_d", "_l")


def migration_specific(c: Corpus, types: DataFrame) -> DataFrame:
    mapping = of_type(c.sections_named(["Type Mapping Reference"]), types, "migration-guide")
    tabled = first_table(c, mapping)
    lacks = ~F.forall(F.array(*map(F.lit, ("area", "old api", "new api"))), lambda want: F.exists("header", lambda h: F.lower(h).contains(want)))
    checklist = of_type(c.sections_named(["Pre-Upgrade Checklist"]), types, "migration-guide")
    items = within(c.items, checklist).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("ordered"), F.col("line_no"))).alias("loose"))
    joined = checklist.join(items, "doc_id", "left")
    return union([
        finding(tabled.where("start_line is null"), "migration-specific", 1, "MIG-04", "line", F.lit("Type Mapping Reference")),
        finding(tabled.where("start_line is not null").where(lacks), "migration-specific", 1, "MIG-04", "start_line", F.lit("Type Mapping Reference")),
        finding(joined.where("n is null"), "migration-specific", 1, "MIG-06", "line", F.lit("Pre-Upgrade Checklist")),
        finding(joined.where("loose is not null"), "migration-specific", 1, "MIG-06", "loose", F.lit("Pre-Upgrade Checklist")),
    ])


def troubleshooting_hub_pointer(c: Corpus, hubs: list[tuple[str, list[str]]]) -> DataFrame:
    """Pages in a hub's scope must point to it and hold no entries of their own.

    ``hubs``: (url of the hub, patterns of page urls).  The list is configuration,
    so it becomes one expression.
    """
    keys = c.front_matter.select("doc_id", F.regexp_replace(F.coalesce(F.col("keys")["url"], F.col("keys")["slug"], F.lit("")), r"^[\"']|[\"']\z", "").alias("url"))
    hub = F.lit(None).cast("string")
    for url, scope in reversed(hubs):
        hub = F.when((F.trim("url") != url) & F.trim("url").rlike("|".join(f"(?:{s})" for s in scope)), F.lit(url)).otherwise(hub)
    pages = keys.where("url <> ''").select("doc_id", hub.alias("hub")).where("hub is not null")
    heads = c.headings.join(pages, "doc_id")
    sections = heads.where(F.lower(F.trim("text")) == "troubleshooting").where("level = 2").select("doc_id", "hub", F.col("line_no").alias("line"), "end_line", F.col("text").alias("section"))
    marks = lambda rows, name, first=1: within(rows, sections.drop("hub"), first=first).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias(name))
    label = spark(r"^\s*\*\*\s*(?:Root causes?|Possible causes?|Resolution)\s*:?\s*\*\*", ignore_case=True)
    links = within(c.links, sections.drop("hub"), first=0).join(pages, "doc_id")
    path = F.regexp_replace(F.regexp_replace("url", r"^https?://[^/]+", ""), r"^/?(?:docs/)?", "")
    links = links.where(F.startswith(path, F.regexp_replace("hub", "^/", ""))).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("links"))
    rows = sections
    for part in (marks(c.headings.select("doc_id", "line_no"), "entries"), marks(c.outside.where(F.col("raw").rlike(label)), "labels"), links):
        rows = rows.join(part, ["doc_id", "line"], "left")
    return finding(rows.where("entries > 0 or labels > 0 or links is null"), "troubleshooting-hub-pointer", 1, "C1-07", "line", "section")


# ---- command-line documents ----------------------------------------------------------------------

FLAG_COLUMNS = ["flag", "type", "required", "default", "description", "notes"]


def cli_specific(c: Corpus, types: DataFrame) -> DataFrame:
    deep = c.headings.where("level >= 4").join(cli_subjects(types), "doc_id", "left_semi")
    heads = F.transform("header", F.lower)
    tables = of_type(c.tables, types, *CLI_TYPES).where((F.size("header") > 2) & F.get(heads, F.lit(0)).isin("flag", "flags", "option", "options") & F.exists(heads, lambda h: h.contains("description")))
    short = tables.where(F.size(F.array_except(F.array(*map(F.lit, FLAG_COLUMNS)), heads)) > 0)
    needs = of_type(c.parsed, types, *[t for t in CLI_TYPES if t != "cli-module-reference"])
    pre = settled(needs.select("doc_id", F.filter("headings", lambda h: h["text"].rlike(r"(?i)^prerequisites?\z")).alias("p")))
    top = F.get(F.filter("p", lambda h: h["level"] == 2), F.lit(0))
    at_top = pre.where(top.isNotNull()).select("doc_id", top["line"].alias("line"), top["end_line"].alias("end_line"), F.lit("Prerequisites").alias("section"))
    loose = within(c.items, at_top).where(~F.col("text").contains("](")).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    installs = of_type(c.may("install", of="every_line"), types, "cli-command-reference").where(F.col("raw").rlike(spark(r"\bplugins:install\b"))).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    placed = c.parsed.where(c.first_section(["Installation", "Install the Plugin"]).isNotNull()).select("doc_id")
    ticks = of_type(c.may("fence", of="every_line"), types, *CLI_TYPES).where(F.col("raw").rlike(spark(r"^\s*```")))
    opened = ticks.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))).where("k % 2 = 1")
    untagged = opened.where(F.col("raw").rlike(spark(r"^\s*```\s*$"))).groupBy("doc_id").agg(F.min("line_no").alias("line_no"))
    p = F.lit("Prerequisites")
    return union([
        finding(deep, "cli-specific", 1, "CLI-05"),
        finding(short, "cli-specific", 1, "CLI-01", "start_line"),
        finding(pre.where(F.size("p") == 0), "cli-specific", 1, "CLI-02", None),
        finding(pre.where((F.size("p") > 0) & top.isNull()), "cli-specific", 1, "CLI-03", F.get("p", F.lit(0))["line"], p),
        finding(loose, "cli-specific", 2, "CLI-04", section=p),
        finding(installs.join(placed, "doc_id", "left_anti"), "cli-specific", 1, "CLI-07"),
        finding(untagged, "cli-specific", 2, "CLI-06"),
    ])


# ---- paragraphs ------------------------------------------------------------------------------------

DEMONSTRATIVE = r"^(This|That|These|Those)\s+[a-z]"
ELEMENTS = (
    r"^(This|That|These|Those)\s+(url|example|snippet|command|code|shape|format|structure|text|payload|output|message|error|diagram|image|screenshot|table|list|order|sequence|"
    r"set|series|section|page|step|steps|values|parameters|options|fields|rows|tabs)\b"
)
CONNECTIVES = (
    r"^(Because|Since|When|Once|Only|Unless|If|After|Before|While|Whereas|Although|Though|Despite|Unlike|Beyond|Apart|Aside|Instead|Rather|Then|Next|Finally|To |For |With|"
    r"Without|Given|Either|Both|Neither|Together|That is|Each|Every|The (first|second|third|last|other|same|rest|remaining))\b"
)
NOT_PROSE = [
    r"^\s*#{1,6}\s", r"^\s*\|", r"^\s*(?:[-*+]\s|\d+[.)]\s)", r"^\s*>", r"^\s*!\[", r"^\s*<", r"^\s*(?:---+|\*\*\*+|___+)\s*$", r"^\s*[a-z_]+:\s",
]


def paragraphs(c: Corpus, least: int = 1) -> DataFrame:
    """Paragraphs of each section's own body (H2 and deeper): opener, sentences, what precedes them.

    Sections of fewer than ``least`` paragraphs are left out before their text is read.
    """
    rows = c.parsed.select("doc_id", "headings", "lines", "fences", F.explode(F.filter("headings", lambda h: h["level"] >= 2)).alias("h"))
    rows = settled(rows.select("doc_id", "lines", "fences", F.col("h.line").alias("section_line"), F.col("h.text").alias("section"), own_lines(F.col("h"), F.col("headings")).alias("own")))
    each = rows.select("doc_id", "section_line", "section", "fences", "lines", F.explode("own").alias("line_no"))
    each = each.select("doc_id", "section_line", "section", "line_no", F.get("lines", F.col("line_no") - 1).alias("raw"), F.exists("fences", lambda f: (F.col("line_no") >= f["start"]) & (F.col("line_no") <= f["stop"])).alias("in_fence"))
    blank = ~F.col("raw").rlike(spark(r"\S"))
    prose = ~F.col("in_fence") & ~blank & ~F.col("raw").rlike(spark("|".join(f"(?:{p})" for p in NOT_PROSE)))
    order = Window.partitionBy("doc_id", "section_line").orderBy("line_no")
    each = each.withColumn("prose", prose).withColumn("block", (F.col("in_fence") | ~blank) & ~F.col("prose"))
    jump = F.coalesce(F.col("line_no") - F.lag("line_no").over(order) > 1, F.lit(False)) | ~F.coalesce(F.lag("prose").over(order), F.lit(False))
    each = each.withColumn("p", F.sum((F.col("prose") & jump).cast("int")).over(order)).withColumn("blocks", F.sum(F.col("block").cast("int")).over(order))
    told = each.where("prose").groupBy("doc_id", "section_line", "section", "p").agg(
        F.min("line_no").alias("line_no"), F.min("blocks").alias("blocks"), F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("rows")
    )
    if least > 1:
        told = told.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("doc_id", "section_line"))).where(F.col("of") >= least)
    text = F.array_join(F.transform("rows", lambda r: r["raw"]), " ")
    text = strip(F.regexp_replace(text, f"[{SPACE}]+", " "))
    counted = F.size(F.filter(F.transform(F.split(F.regexp_replace(text, "`[^`]*`", " CODE "), f"(?<=[.?!])[{SPACE}]+(?=[A-Z`\"'(])"), strip), lambda s: s != ""))
    opener = strip(F.col("rows")[0]["raw"])
    word = F.lower(F.get(F.split(strip(F.regexp_replace(opener, f"^\\*\\*|^[-*+][{SPACE}]+", "")), "[^A-Za-z-]+"), F.lit(0)))
    section = Window.partitionBy("doc_id", "section_line").orderBy("p")
    return told.select(
        "doc_id", "section_line", "section", "p", "line_no", text.alias("text"), counted.alias("sentences"),
        opener.rlike(spark(r"^\s*\*\*[^*]+\*\*")).alias("bold"),
        (opener.rlike(spark(DEMONSTRATIVE)) & ~opener.rlike(spark(ELEMENTS, ignore_case=True))).alias("demonstrative"),
        (opener.rlike(spark(CONNECTIVES)) | imperative(word)).alias("joined"),
        (F.col("blocks") > F.coalesce(F.lag("blocks").over(section), F.lit(0))).alias("after_block"),
    )


def cohesion_signals(c: Corpus) -> DataFrame:
    """Sections of three paragraphs or more that no opener, label or length ties together."""
    order = Window.partitionBy("doc_id", "section_line").orderBy("p")
    rows = paragraphs(c, least=3)
    prev, nxt = F.lag("sentences").over(order), F.lead("sentences").over(order)
    lone = (F.col("sentences") == 1) & ~F.col("after_block") & ~F.lead("after_block").over(order) & (prev > 1) & (nxt > 1)
    rows = rows.withColumn("orphan", F.coalesce(lone, F.lit(False))).withColumn("k", F.row_number().over(order))
    sums = rows.groupBy("doc_id", "section_line", "section").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("bold").cast("int")).alias("bold"), F.sum(F.col("demonstrative").cast("int")).alias("demonstratives"),
        F.sum(F.col("orphan").cast("int")).alias("orphans"), F.sum((F.col("joined") & (F.col("k") > 1)).cast("int")).alias("joined"), F.min("line_no").alias("line_no"),
    )
    wall = (F.col("n") >= 4) & (F.col("joined") / (F.col("n") - 1) < 0.5)
    return sums.where("n >= 3 and bold = 0").where((F.col("demonstratives") >= 2) | (F.col("orphans") > 0) | wall)


def paragraph_cohesion(c: Corpus) -> DataFrame:
    return finding(cohesion_signals(c), "paragraph-cohesion", 2, "C2-09", section="section")


