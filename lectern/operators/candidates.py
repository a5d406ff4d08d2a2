"""Candidates for review: places a reader must judge, found by a signal.

A candidate is doc_id, line_no, rule_id, also_covers, generator, section.  A
generator never decides; its rows are joined with verdicts in ``review``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import SPACE, any_of, spark
from lectern.functions.relations import Corpus, own_lines, settled, text_of
from lectern.functions.scalars import prose, prose_mask, strip, word_count
from lectern.operators import prose as prose_checks
from lectern.operators import structure, tables
from lectern.operators.findings import union
from lectern.operators.wordlist_data import WORDLISTS
from lectern.operators.wordlists import next_content, pattern_of

Rows = DataFrame


def candidate(rows: DataFrame, generator: str, rules: list[str] | tuple[Column, Column], line: str | Column = "line_no", section: str | Column | None = "section") -> DataFrame:
    rule, also = (F.lit(rules[0]), F.lit(",".join(rules[1:]))) if isinstance(rules, list) else rules
    at = F.col(line) if isinstance(line, str) else line
    where = F.lit(None).cast("string") if section is None else (F.col(section) if isinstance(section, str) else section)
    return rows.select("doc_id", at.cast("int").alias("line_no"), rule.alias("rule_id"), also.alias("also_covers"), F.lit(generator).alias("generator"), where.alias("section"))


def has(column: str | Column, pattern: str, ignore_case: bool = True) -> Column:
    return (F.col(column) if isinstance(column, str) else column).rlike(spark(pattern, ignore_case=ignore_case))


def in_sections(c: Corpus, *sieves: str) -> DataFrame:
    return c.may(*sieves, of="sectioned")


def under(c: Corpus, rows: DataFrame, strictly: bool = True) -> DataFrame:
    """``rows`` with the title of the last heading above (or on, if not strictly) their line."""
    heads = c.parsed.select(F.col("doc_id").alias("_d"), "headings")
    above = lambda h: (h["line"] < F.col("line_no")) if strictly else (h["line"] <= F.col("line_no"))
    joined = rows.join(heads, F.col("doc_id") == F.col("_d"))
    found = F.filter("headings", above)
    return joined.withColumn("section", F.get(found, F.size(found) - 1)["text"]).drop("_d", "headings")


def sections(c: Corpus) -> DataFrame:
    """Sections of H2 and below: line_no, end_line, level, section, body (own lines), top (title of the H2 above)."""
    rows = c.parsed.select("doc_id", "headings", "lines", F.explode(F.filter("headings", lambda h: h["level"] >= 2)).alias("h"))
    tops = F.filter("headings", lambda s: (s["level"] == 2) & (s["line"] < F.col("h.line")))
    return settled(rows.select(
        "doc_id", F.col("h.line").alias("line_no"), F.col("h.end_line").alias("end_line"), F.col("h.level").alias("level"), F.col("h.text").alias("section"),
        text_of(own_lines(F.col("h"), F.col("headings")), F.col("lines")).alias("body"), F.get(tops, F.size(tops) - 1)["text"].alias("top"),
    ))


STOP = "a an and are as at be by for from how in is it its of on or that the this to what with you your".split()


def content_words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "`[^`]*`", " "), "[^a-z]+"), lambda w: (F.length(w) > 2) & ~w.isin(STOP))


def split_loose(text: Column) -> Column:
    """Sentences after . ! ? and white space, whatever follows."""
    return F.filter(F.transform(F.split(text, f"(?<=[.!?])[{SPACE}]+"), strip), lambda s: s != "")


MARKER = r"^\s*(?:[-*+]|\d+[.)])\s+"
TITLE = r"^#{1,6}\s"
CONSEQUENCE = r"\b(because|otherwise|or else|fails?|breaks?|results? in|leads? to|so that|which means)\b"
STRONG = r"\b(must not|must|never|always|do not|you need to)\b"
MODAL = r"\b(must not|must|cannot|never|always|required|do not|you need to)\b"


def heading_accuracy(c: Corpus) -> Rows:
    plain = ~has(F.trim("section"), r"^(overview|prerequisites|next steps|limitations|troubleshooting|quick start|quick reference)$") & ~F.coalesce(has("top", "troubleshooting"), F.lit(False))
    rows = sections(c).where(plain).withColumn("b", F.array_distinct(content_words(F.col("body")))).withColumn("t", content_words(F.col("section")))
    return candidate(rows.where((F.size("b") >= 25) & (F.size("t") >= 2) & ~F.arrays_overlap("t", "b")), "heading_accuracy", ["C6-01", "B1-02", "B2-02"])


def item_shape(text: Column) -> Column:
    plain = F.trim(F.replace(text, F.lit("**"), F.lit("")))
    return (
        F.when(plain.startswith("`"), "code").when(plain.startswith("["), "link")
        .when(plain.rlike("^[A-Z][a-z]+ [a-z]"), "nounPhrase").when(has(plain, r"^[a-z]+\b", False), "lowercase").otherwise("other")
    )


def category_coherence(c: Corpus) -> Rows:
    order = Window.partitionBy("doc_id").orderBy("line_no")
    items = c.items.where("not ordered and indent = 0")
    runs = items.withColumn("run", F.sum(F.coalesce((F.col("line_no") - F.lag("line_no").over(order) > 2).cast("int"), F.lit(0))).over(order))
    groups = runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.count_distinct(item_shape(F.col("text"))).alias("shapes"))
    return candidate(under(c, groups.where("n >= 3 and shapes >= 2")), "category_coherence", ["C6-02", "B1-03", "B2-05"])


def consequence_order(c: Corpus) -> Rows:
    around = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-2, 2)
    lines = c.only("strong").every_line.withColumn("near", F.array_join(F.collect_list("raw").over(around), " ")).where("is_body and not in_fence")
    strong = lines.where(has("raw", STRONG) & ~has("near", CONSEQUENCE))
    return candidate(under(c, strong), "consequence_order", ["C4-01", "B1-04", "B2-03"])


def prose_as_table(c: Corpus) -> Rows:
    """Paragraphs of parallel sentences in sections without table or list; nested sections repeat them."""
    c = c.only("parallel")
    s = sections(c).select("doc_id", F.col("line_no").alias("section_line"), "end_line", "section")
    held = c.items.select("doc_id", F.col("line_no").alias("at")).union(c.tables.select("doc_id", F.col("start_line").alias("at")))
    busy = s.join(held, "doc_id").where("at between section_line and end_line").select("doc_id", "section_line").distinct()
    bare = s.join(busy, ["doc_id", "section_line"], "left_anti")
    lines = bare.join(c.outside.select("doc_id", "line_no", "raw"), "doc_id").where("line_no > section_line and line_no <= end_line")
    order = Window.partitionBy("doc_id", "section_line").orderBy("line_no")
    gap = ~has("raw", r"\S") | F.col("raw").rlike("^#{1,6} ")
    paras = lines.withColumn("gap", gap).withColumn("p", F.sum(gap.cast("int")).over(order)).where("not gap").groupBy("doc_id", "section_line", "section", "p").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("raw")).alias("t")))), lambda x: x["t"]), " ").alias("text"))
    parallel = F.regexp_count("text", F.lit(spark(r"\b(if|either|whereas|instead|alternatively|when you|for a)\b", ignore_case=True)))
    return candidate(paras.where((F.size(split_loose(F.col("text"))) >= 3) & (parallel >= 2)), "prose_as_table", ["C2-01", "B1-05", "C2-02"])


def skip_consequences(c: Corpus) -> Rows:
    order = Window.partitionBy("doc_id").orderBy("line_no")
    items = c.items.where("ordered and indent = 0")
    runs = items.withColumn("run", F.sum(F.coalesce((F.col("line_no") - F.lag("line_no").over(order) > 2).cast("int"), F.lit(0))).over(order))
    blocks = runs.groupBy("doc_id", "run").agg(F.min("line_no").alias("line_no"), F.count(F.lit(1)).alias("n"), F.max(has("text", CONSEQUENCE).cast("int")).alias("told"))
    return candidate(under(c, blocks.where("n >= 2 and told = 0")), "skip_consequences", ["B1-11"])


#: Who takes part, unless a call names others.
ACTORS = ("client", "runtime", "server", "browser", "agent", "user", "model", "CDN", "proxy")


def diagram_needed(c: Corpus, actors: tuple[str, ...] = ACTORS) -> Rows:
    c = c.only("actor") if actors == ACTORS else c
    s = sections(c).where(~F.col("body").rlike("^(```|~~~)") & ~F.col("body").contains("!["))
    named = F.size(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(spark(rf"\b({'|'.join(actors)})\b")), 1), F.lower)))
    steps = s.join(c.items.where("ordered").select("doc_id", F.col("line_no").alias("at")), "doc_id").where("at between line_no and end_line").groupBy("doc_id", "line_no").agg(F.count(F.lit(1)).alias("steps"))
    return candidate(s.where(named >= 3).join(steps, ["doc_id", "line_no"]).where("steps >= 3"), "diagram_needed", ["C2-03"])


def external_values(c: Corpus) -> Rows:
    s = sections(c.only("code")).where(F.regexp_count("body", F.lit("`[^`]*`")) >= 4)
    linked = s.join(c.links.select("doc_id", F.col("line_no").alias("at")), "doc_id").where("at between line_no and end_line").select("doc_id", "line_no").distinct()
    noted = F.exists(F.split("body", "\n"), lambda x: x.rlike(spark(r"^\s*(>|\*\*Note)", ignore_case=True)))
    return candidate(s.where(~noted).join(linked, ["doc_id", "line_no"], "left_anti"), "external_values", ["C2-06"])


def options_in_code(c: Corpus) -> Rows:
    s = sections(c.only("code")).where(~F.col("body").rlike("^(```|~~~)")).select("doc_id", F.col("line_no").alias("at"), "end_line", "section")
    lines = c.may("code", of="outside").where((F.regexp_count("raw", F.lit("`[^`]*`")) >= 2) & has("raw", MODAL)).select("doc_id", "line_no")
    return candidate(s.join(lines, "doc_id").where("line_no > at and line_no <= end_line"), "options_in_code", ["C4-04"])


def cross_reference_summary(c: Corpus) -> Rows:
    rows = c.links.select("doc_id", "line_no", "ord").join(c.may("link", of="every_line").select("doc_id", "line_no", "raw"), ["doc_id", "line_no"]).where(has("raw", r"^\s*[-*]\s"))
    after = F.when(F.col("raw").contains(")"), F.substring("raw", F.instr("raw", ")") + 1, F.char_length("raw"))).otherwise(F.col("raw"))
    placed = under(c, rows.where(word_count(after) < 8))
    return candidate(placed.where(~F.coalesce(has("section", "next steps"), F.lit(False))), "cross_reference_summary", ["C5-02"])


def _title(c: Corpus) -> DataFrame:
    h1 = F.get(F.filter("headings", lambda h: h["level"] == 1), F.lit(0))
    return c.parsed.select("doc_id", "headings", F.coalesce(h1["line"], F.col("body_start")).alias("line_no"), h1["text"].alias("section"))


def limitations_coverage(c: Corpus) -> Rows:
    return candidate(_title(c).where(~F.exists("headings", lambda h: F.lower(h["text"]) == "limitations")), "limitations_coverage", ["C9-04"])


def routing_only(c: Corpus) -> Rows:
    return union([candidate(_title(c), "routing_only", [r]) for r in ("C4-06", "C7-03")])


DEFECT = r"\b(silently|quietly|misleading|does nothing|has no effect|not supported yet|no warning|without warning|no counter)\b"
DISCLOSURE = r"\b(internal to the app|fails? open|serves every|short-lived token|POST\s+/api/|PUT\s+/api/|\.ts:\d+|\.tsx:\d+|lib/[a-z-]+/)\b"


def defect_framing(c: Corpus) -> Rows:
    return candidate(in_sections(c, "defect").where(has("raw", DEFECT)), "defect_framing", ["C8-09"])


def internal_disclosure(c: Corpus) -> Rows:
    return candidate(in_sections(c, "disclosure").where(has("raw", DISCLOSURE)), "internal_disclosure", ["C6-04"])


def heading_product_output(c: Corpus) -> Rows:
    heads = c.headings.where("level > 1").where(word_count(F.regexp_replace("text", "`[^`]*`", "X")) > 4)
    entries = structure.next_prose(c.only("long heading")).where(has("next_prose", r"^\s*\*\*Root Cause\*\*", False)).select("doc_id", "line_no")
    return candidate(heads.join(entries, ["doc_id", "line_no"]), "heading_product_output", ["C2-07"], section="text")


def table_adjacent_block(c: Corpus) -> Rows:
    blocks = tables.blocks_after(c, 12).where("kind in ('callout', 'lead-in')").select("doc_id", "start_line", "line_no")
    homes = in_sections(c.only("pipe")).select("doc_id", "line_no", "section")
    return candidate(blocks.join(homes, ["doc_id", "line_no"], "left"), "table_adjacent_block", ["C7-05"])


CHANGES = r"\b(change|edit|update|modify|configure|set|adjust|rename)\s+(?:its|the|your|their)?\s*([a-z][\w-]*(?:,\s*[a-z][\w-]*)*\s+(?:or|and)\s+[a-z][\w-]*)\b"


def enumeration_completeness(c: Corpus) -> Rows:
    rows = in_sections(c, "enumeration").where(~has("raw", r"\b(for example|such as|among (?:them|others)|including)\b") & has(F.regexp_replace("raw", "`[^`]*`", " "), CHANGES))
    return candidate(rows, "enumeration_completeness", ["C3-16"])


QUANTIFIER = r"\b(most|some|several|a few|many|occasionally|usually|often|typically|generally)\b"


def vague_quantifier(c: Corpus) -> Rows:
    rows = in_sections(c, "quantifier").where(~has("said", r"^(?:\||>|#{1,6}\s)")).withColumn("t", F.regexp_replace("said", "`[^`]*`", " "))
    first = F.regexp_extract("t", spark(rf"\b(?:at (?:most|least)\b)|{QUANTIFIER}", ignore_case=True), 1)
    behaviour = has("t", r"\b(client|clients|runtime|server|profile|profiles|tool|tools|call|calls|the app|the wizard|the view|catalog|catalogs|model|models|agent|agents)\b", False)
    return candidate(rows.where((first != "") & behaviour), "vague_quantifier", ["C3-17"])


def overview_opener(c: Corpus) -> Rows:
    """The first sentence of the overview (or first H2) opens on something else than the page's topic."""
    named = c.parsed.select("doc_id", F.coalesce(c.first_section(["Overview"]), F.get(F.filter("headings", lambda h: h["level"] == 2), F.lit(0))).alias("s")).where("s is not null")
    lines = c.outside.join(named, "doc_id").where("line_no > s.line and line_no <= s.end_line").where(has("raw", r"\S") & ~has("raw", r"^\s*[|>#\-*\d]", False))
    first = lines.groupBy("doc_id", F.col("s.text").alias("section")).agg(F.min("line_no").alias("line_no"), F.min_by("raw", "line_no").alias("raw"))
    opener = F.get(split_loose(strip(F.col("raw"))), F.lit(0))
    dependent = has(opener, r"^(Beyond|In addition to|Apart from|Aside from|Besides|Unlike|Rather than|Instead of|As well as|While|Although|Though|Once|After|Before|Because|Since)\b")
    pivot = F.size(F.split(F.regexp_extract(opener, spark(r"^(.*?),\s+so\s"), 1), f"[{SPACE}]+")) >= 8
    return candidate(first.where(dependent | (has(opener, r",\s+so\s", False) & pivot)), "overview_opener", ["C6-05"])


HOVER = r"\b(hovers?|hovering|icons?|reveals?)\b"


def hover_label(c: Corpus) -> Rows:
    rows = in_sections(c, "hover").where(~has("said", r"^(?:\||#{1,6}\s)") & has("said", HOVER))
    return candidate(rows.where(F.size(F.filter(F.regexp_extract_all("said", F.lit(r"\*\*([^*]+)\*\*"), 1), lambda b: F.trim(b) != "")) > 0), "hover_label", ["C4-08"])


def gerund_subject(c: Corpus) -> Rows:
    rows = in_sections(c, "gerund").where((F.col("said") != "") & ~has("said", r"^(?:\||>|#{1,6}\s)"))
    body = F.regexp_replace(F.regexp_replace("said", spark(r"^(?:[-*+]|\d+\.)\s+"), ""), spark(r"^\*\*[^*]+\*\*:?\s*"), "")
    hit = F.exists(split_loose(body), lambda s: s.rlike(spark(r"^([A-Z][a-z]+ing)\b|,\s+(?:so|and|but)\s+([a-z]+ing)\b")))
    return candidate(rows.where(hit), "gerund_subject", ["C3-20"])


def _running(c: Corpus, skip: str, *sieves: str) -> DataFrame:
    """Sentences of prose lines in H2 sections: doc_id, line_no, section, ord, sentence."""
    rows = in_sections(c, *sieves).where((F.col("said") != "") & ~has("said", skip))
    return rows.select("doc_id", "line_no", "section", "section_line", F.posexplode(split_loose(F.regexp_replace("said", spark(MARKER), ""))).alias("ord", "sentence"))


def house_verbs(c: Corpus) -> Rows:
    rows = _running(c, r"^(?:\||>|#{1,6}\s)", "house-verbs").withColumn("said", prose(F.col("sentence")))
    hit = has("said", any_of([pattern_of(e) for e in WORDLISTS["house-verbs"]]))
    return candidate(rows.where(hit).withColumn("key", F.substring("sentence", 1, 60)).dropDuplicates(["doc_id", "line_no", "key"]), "house_verbs", ["C3-21"])


HAND_OFF = r"\b(ask(s|ed|ing)?|rais(e|es|ed|ing)|contact(s|ed|ing)?|consult(s|ed|ing)?|check(s|ed|ing)?|confirm(s|ed|ing)?|refer|wait)\b"


def missing_destination(c: Corpus) -> Rows:
    """Hand-off verbs with nowhere to go after them, where the reader is meant to act."""
    rows = in_sections(c.only("hand-off"))
    label = r"^\s*\*\*(Resolution|Fix|Workaround)\*\*"
    order = Window.partitionBy("doc_id", "section_line").orderBy("line_no")
    flag = F.when(has("said", label), True).when(has("said", r"^\s*\*\*Root Cause|^#{1,6}\s"), False)
    rows = rows.withColumn("acting", F.coalesce(F.last(flag, ignorenulls=True).over(order), F.lit(False))).where((F.col("said") != "") & ~has("said", TITLE))
    step = r"^\s*(?:\d+[.)]|[-*+])\s+"
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("said", spark(label, True), ""), spark(r"^:\s*"), ""), spark(step), "")
    each = rows.select("doc_id", "line_no", "section", "acting", "said", F.posexplode(split_loose(body)).alias("ord", "sentence"))
    verb = spark(HAND_OFF, ignore_case=True)
    at = F.regexp_instr("sentence", F.lit(verb))
    each = each.withColumn("at", at).where("at > 0").withColumn("before", F.substring("sentence", F.lit(1), F.col("at") - 1)).withColumn("after", F.substring("sentence", F.col("at"), F.char_length("sentence")))
    place = F.col("acting") | has("said", step, False) | F.col("said").startswith("|") | has("before", r"(^|[.,;:]\s+)(so|or|then)\s+$") | (F.trim("before") == "")
    return candidate(each.where(~has("after", r"\]\([^)]*\)|https?://|mailto:|\*\*[^*]+\*\*", False) & place), "missing_destination", ["C5-06"])


def false_contrast(c: Corpus) -> Rows:
    rows = _running(c, r"^(?:\||#{1,6}\s)", "contrast")
    return candidate(rows.where(has(prose(F.col("sentence")), r",\s+(but|yet)\s+|\b(however|though|whereas)\b")), "false_contrast", ["C3-22"])


_WORDS = re.compile("[a-z0-9]+")


def fact_groups(sentences: list[str], floor: float, n: int = 5) -> list[dict[str, int]]:
    """m, i: the place of each lower-cased sentence that shares a group, and of the sentence its group began with.

    Only sentences sharing a shingle are compared, and of those with one set of
    shingles only the first.  A sentence seeds a group if no earlier seed took it.
    """
    sets: dict[tuple, list[int]] = {}
    for k, sentence in enumerate(sentences):
        w = _WORDS.findall(sentence)
        if len(w) >= n:
            sets.setdefault(tuple(dict.fromkeys(zip(*(w[d:] for d in range(n)), strict=False))), []).append(k)
    holders: dict[tuple, list[int]] = {}
    sizes, pairs = {}, []
    for grams, own in sets.items():
        met: dict[int, int] = {}
        for g in grams:
            if g in holders:
                for i in holders[g]:
                    met[i] = met.get(i, 0) + 1
                holders[g].append(own[0])
            else:
                holders[g] = [own[0]]
        sizes[own[0]] = len(grams)
        pairs += [(i, own[0]) for i, both in met.items() if both / (sizes[i] + len(grams) - both) >= floor]
    seed_of: dict[int, int] = {}
    for i, j in sorted(pairs):
        # A seed may add to its own group; a member of another group neither seeds nor joins.
        if j not in seed_of and seed_of.get(i, i) == i:
            seed_of[i] = seed_of[j] = i
    return [{"m": m, "i": seed_of.get(own[0], own[0])} for own in sets.values() if own[0] in seed_of or len(own) > 1 for m in own]


def repeated_fact(c: Corpus, floor: float = 0.5, least_words: int = 7) -> Rows:
    """Sentences of one document that say the same: greedy groups around the first sentence, in order."""
    rows = in_sections(c).where((F.col("said") != "") & ~has("said", r"^(?:\||#{1,6}\s)"))
    said = F.regexp_replace(prose(F.col("said")), spark(MARKER), "")
    each = rows.select("doc_id", "line_no", "section", F.posexplode(split_loose(said)).alias("ord", "sentence")).where(word_count(F.col("sentence")) >= least_words)
    docs = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "ord", F.lower("sentence").alias("sentence"), "section"))).alias("all")).where(F.size("all") > 1)
    kind = "array<struct<m:int,i:int>>"

    def grouped(texts: pa.Array) -> pa.Array:
        return pa.array([fact_groups(x, floor) for k in range(0, len(texts), 256) for x in texts.slice(k, 256).to_pylist()], pa.list_(pa.struct([("m", pa.int32()), ("i", pa.int32())])))

    told = docs.withColumn("told", F.arrow_udf(grouped, kind)(F.col("all.sentence")))
    taken = told.select("doc_id", "all", F.inline("told")).select("doc_id", "i", "m", F.get("all", F.col("m"))["line_no"].alias("line_no"), F.get("all", F.col("m"))["section"].alias("section"))
    groups = taken.groupBy("doc_id", "i").agg(F.min("line_no").alias("line_no"), F.min_by("section", "m").alias("section"), F.max((F.lower("section") == "prerequisites").cast("int")).alias("pre"))
    return candidate(groups, "repeated_fact", (F.lit("C7-06"), F.when(F.col("pre") == 1, "C7-02").otherwise("")))


#: Concepts, the patterns that name them, and the wording that describes them.
CONCEPTS = [
    (r"\bauth(entication)? token\b", r"\bshort[- ]lived\b|\bnever displays\b|\bissues for its own use\b|\bfor its own use\b"),
    (r"\baccess token\b|\brefresh token\b", r"\bshort[- ]lived\b|\bcaches it locally\b|\brefreshes it\b"),
    (r"\b(management|delivery) token\b", r"\b(you )?supply the tokens\b"),
    (r"`tools/list`", r"\b(a|the) client lists the tools\b|\blists the tools a profile\b"),
    (r"`enum`", r"\bthe list of [a-z]+ that exist\b|\bcarries the list of\b"),
    (r"\bDynamic Client Registration\b", r"\bno client ID and no client secret\b"),
    (r"\bHTTP (Request )?[Tt]rigger\b", r"\bworks as an unauthenticated webhook\b|\bunauthenticated webhook\b"),
    (r"`inputSchema`|\binput schema\b", r"\bno parameter names\b|\bno schema to fill\b"),
]


def circled_concept(c: Corpus) -> Rows:
    rows = in_sections(c, "circled").where((F.col("said") != "") & ~has("said", TITLE)).withColumn("t", prose(F.col("said")))
    hit = F.lit(False)
    for name, described in CONCEPTS:
        hit = hit | (has("t", described) & ~has("said", name))
    return candidate(rows.where(hit), "circled_concept", ["C3-23"])


#: Words that point elsewhere on a page.
DIRECTION = r"\b(below|above|following|preceding|earlier|later|next|previous|shown|listed|here)\b"


def unanchored_block(c: Corpus) -> Rows:
    """Blocks opening after prose that does not point at them, and pronouns opening after a block; once per line."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    some = F.when(has("raw", r"\S") & F.col("is_body"), F.struct("line_no", "raw", "in_fence"))
    rows = c.only("block").every_line.withColumn("prev", F.last(some, ignorenulls=True).over(before)).withColumn("was", F.lag("in_fence", 1, False).over(order))
    rows = rows.where(F.col("is_body") & has("raw", r"\S") & F.col("prev").isNotNull()).withColumn("said", strip(F.col("raw"))).withColumn("p", strip(F.col("prev.raw")))
    opens = (F.col("in_fence") & ~F.col("was")) | (~F.col("in_fence") & F.col("said").startswith("|") & ~F.col("p").startswith("|"))
    lead = ~F.col("prev.in_fence") & ~has("p", r"^(?:#{1,6}\s|\||!\[)", False) & ~has(F.col("prev.raw"), r":\s*$", False) & ~has("p", DIRECTION)
    first = rows.where(opens & lead).select("doc_id", F.col("prev.line_no").alias("line_no"))
    bare = F.regexp_replace("said", spark(MARKER), "")
    pronoun = ~F.col("in_fence") & ~opens & has(bare, r"^(it|they|these|those|this|that)\b") & ~has("said", r"^(?:#{1,6}\s|\|)") & (has("p", r"^!\[|^\|", False) | F.col("prev.in_fence"))
    both = first.union(rows.where(pronoun).select("doc_id", "line_no")).distinct()
    return candidate(under(c, both, strictly=False), "unanchored_block", ["C3-25"])


#: What a lead-in can name.
ELEMENT = (
    r"\b(tables?|lists?|columns?|rows?|steps?|urls?|links?|commands?|examples?|snippets?|blocks?|code|outputs?|messages?|errors?|formats?|payloads?|parameters?|arguments?|"
    r"fields?|options?|sections?|diagrams?|entries|entry|responses?|requests?|files?|settings?|screens?|tabs?|dialog|text|order|sequence|paragraphs?|cases?|rules?)\b"
)


def unnamed_lead_in(c: Corpus) -> Rows:
    rows = c.may("colon").where(has("raw", r":\s*$", False)).withColumn("said", strip(F.col("raw"))).where(~has("said", r"^(?:#{1,6}\s|\|)"))
    joined = rows.join(next_content(c.only("colon")), ["doc_id", "line_no"]).where("next_raw is not null")
    opens = F.col("next_in_fence") | has("next_raw", r"^\s*\||^\s*(?:[-*+]\s|\d+[.)]\s)", False)
    parts = split_loose(F.regexp_replace(prose(F.col("said")), spark(MARKER), ""))
    told = joined.where(opens).withColumn("parts", parts).withColumn("last", F.get("parts", F.size("parts") - 1)).where("last is not null")
    points = has("last", DIRECTION) | has("last", ELEMENT) | has("last", r"\b(two|three|four|five|six|seven|eight|nine|ten|\d+)\s+[a-z]+s\b") | F.col("said").rlike(r"\[[^\]]+\]\([^)]+\)")
    return candidate(under(c, told.where(~points), strictly=False), "unnamed_lead_in", ["C3-26"])


def paragraph_cohesion(c: Corpus) -> Rows:
    return candidate(structure.cohesion_signals(c), "paragraph_cohesion", ["C2-09"])


def third_party_ui(c: Corpus) -> Rows:
    step = r"^\s*(?:\d+[.)]\s+|[-*+]\s+)?(?:Open|Choose|Click|Select|Go to|Navigate|Enable|Add|Paste|Turn|Sign in|Log in|Install|Run|Use|Save|Approve)\b"
    rows = prose_checks.vendor_lines(c).where("vendor").where(~has("raw", r"^\s*#{1,6}\s"))
    bold = F.regexp_replace("raw", "`[^`]*`", " ").rlike(r"\*\*[^*]+\*\*")
    return candidate(rows.where(bold | has("raw", step, False)), "third_party_ui", ["C4-09", "C5-07"], section=None)


CLAIM = r"\bfull support\b|\bmost effort of any\b|\btakes the most\b|\bfully support(s|ed)?\b"


def over_promise(c: Corpus) -> Rows:
    said = prose(F.col("raw"))
    hit = has(said, any_of([pattern_of(e) for e in WORDLISTS["over-promise"]]))
    claim = has(said, CLAIM)
    rows = c.may("claim").withColumn("hit", hit).where(F.col("hit") | claim)
    return candidate(rows, "over_promise", (F.when(F.col("hit"), "C8-10").otherwise("C6-08"), F.when(F.col("hit"), "C6-08").otherwise("C8-10")), section=None)


CASUAL = (
    r"\b(?:a bit|pretty (?:much|easy|simple|quick)|really|basically|simply|a lot of|lots of|stuff|kind of|sort of|okay|handy|neat|awesome|don't worry|no worries|feel free|"
    r"let's|we'll|we're|hassle|tweak|play around|a bunch of|takes? care of|nothing (?:else|more)|all there is|needs? nothing)\b|!(?=\s|$)"
)


def casual_register(c: Corpus) -> Rows:
    rows = c.may("casual").where(has("raw", r"\S") & ~has("raw", r"^\s*(?:#{1,6}\s|\||<)"))
    return candidate(rows.where(has(prose(F.col("raw")), CASUAL)), "casual_register", ["C3-33", "C3-01"], section=None)


def skimmable_sentence(c: Corpus) -> Rows:
    return candidate(prose_checks.skimmable_sentence(c), "skimmable_sentence", ["C2-16", "C3-07"], section=None)


#: Numbers as words, units that are not counted things, and verbs that look like plurals.
NUMBERS = "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
UNITS = "times seconds minutes hours days weeks months years px pixels rem em kb mb gb ms percent chars characters tokens words lines bytes columns col cols".split()
NOT_NOUNS = "is was has as its this thus plus less says does goes lets gets runs needs means holds takes uses ends starts stays works reads writes returns always perhaps yes versus vs".split()


def numeric_consistency(c: Corpus) -> Rows:
    """Counts that point at the page where the list, table or run of headings that follows has another size."""
    number = rf"\b({'|'.join([*NUMBERS, 'both'])}|[2-9]|[1-9][0-9])\b(?=\s+([a-zA-Z][a-zA-Z-]*))"
    quick = c.may("pointing count").where(has("raw", number)).withColumn("m", prose_mask("raw"))
    pointing = has("m", r"\b(below|above|following|here|listed|these|those|next)\b") | has("raw", r"^#{1,6}\s", False) | has("raw", r":\s*$", False)
    pairs = F.arrays_zip(F.regexp_extract_all("m", F.lit(spark(number, True)), 1).alias("token"), F.regexp_extract_all("m", F.lit(spark(number, True)), 2).alias("noun"))
    claims = quick.where(pointing).select("doc_id", "line_no", F.explode(pairs).alias("x")).select("doc_id", "line_no", F.lower("x.token").alias("token"), F.lower("x.noun").alias("noun"))
    value = F.when(F.col("token") == "both", 2).when(F.col("token").rlike("^[0-9]+$"), F.col("token").try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, NUMBERS)), F.col("token")) + 1)
    claims = claims.where(~F.col("noun").isin([*UNITS, *NOT_NOUNS]) & ((F.col("token") == "both") | F.col("noun").endswith("s"))).withColumn("value", value.cast("int"))
    # The first line with content among the five below decides what follows.
    c = c.only("pointing count")
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, 5)
    some = F.when(has("raw", r"\S") & ~F.col("in_fence"), F.struct("line_no", "raw"))
    nexts = c.every_line.select("doc_id", "line_no", F.first(some, ignorenulls=True).over(ahead).alias("n")).where("n is not null")
    met = claims.join(nexts, ["doc_id", "line_no"]).select("doc_id", "line_no", "value", F.col("n.line_no").alias("at"), F.col("n.raw").alias("raw"))
    sized = met.join(c.tables.select("doc_id", F.col("start_line").alias("at"), F.size("rows").alias("size")), ["doc_id", "at"]).where(has("raw", r"^\s*\|", False)).select("doc_id", "line_no", "value", "size")
    heads = c.parsed.select("doc_id", "headings")
    run = met.where(has("raw", r"^#{1,6}\s+.*$", False)).join(heads, "doc_id")
    level = F.length(F.regexp_extract("raw", r"^(#{1,6})", 1))
    stop = F.coalesce(F.get(F.filter("headings", lambda h: (h["line"] >= F.col("at")) & (h["level"] < level)), F.lit(0))["line"], F.lit(1 << 30))
    run = run.select("doc_id", "line_no", "value", F.size(F.filter("headings", lambda h: (h["line"] >= F.col("at")) & (h["line"] < stop) & (h["level"] == level))).alias("size")).where("size >= 2")
    lists = met.where(has("raw", r"^\s*(?:[-*+]|\d+[.)])\s+\S", False)).join(list_sizes(c), ["doc_id", "at"]).select("doc_id", "line_no", "value", "size")
    both = sized.union(run).union(lists).where("value between 2 and 99 and value <> size")
    return candidate(both, "numeric_consistency", ["C2-13"], section=None)


def list_sizes(c: Corpus) -> DataFrame:
    """doc_id, at, size: items of the list that starts at each item line, nested items not counted.

    A list ends at a second blank line since the last item, or at a line that is
    neither an item nor indented deeper than its first.
    """
    lines = c.every_line.select("doc_id", F.col("line_no").alias("n"), "raw", "in_fence")
    shape = F.struct(
        F.col("n"), F.col("in_fence").alias("fence"), (~has("raw", r"\S")).alias("blank"),
        F.length(F.regexp_extract("raw", f"^([{SPACE}]*)", 1)).alias("indent"), has("raw", r"^\s*(?:[-*+]|\d+[.)])\s+\S", False).alias("item"),
    )
    docs = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(shape)).alias("rows"))
    starts = docs.select("doc_id", "rows", F.explode(F.filter("rows", lambda r: r["item"] & ~r["fence"])).alias("s"))
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("blanks"), F.lit(False).alias("done"))

    def step(acc: Column, r: Column) -> Column:
        own = r["item"] & (r["indent"] <= F.col("s.indent"))
        deeper = r["indent"] > F.col("s.indent")
        return (
            F.when(acc["done"] | r["fence"], acc)
            .when(r["blank"], F.struct(acc["size"].alias("size"), (acc["blanks"] + 1).alias("blanks"), (acc["blanks"] >= 1).alias("done")))
            .when(own, F.struct((acc["size"] + 1).alias("size"), F.lit(0).alias("blanks"), F.lit(False).alias("done")))
            .when(deeper, F.struct(acc["size"].alias("size"), F.lit(0).alias("blanks"), F.lit(False).alias("done")))
            .otherwise(F.struct(acc["size"].alias("size"), acc["blanks"].alias("blanks"), F.lit(True).alias("done")))
        )

    rest = F.slice("rows", F.col("s.n"), F.greatest(F.size("rows") - F.col("s.n") + 1, F.lit(1)))
    return starts.select("doc_id", F.col("s.n").alias("at"), F.aggregate(rest, zero, step, lambda a: a["size"]).alias("size"))


GENERATORS: dict[str, Callable[[Corpus], DataFrame]] = {
    g.__name__: g
    for g in (
        heading_accuracy, house_verbs, missing_destination, false_contrast, repeated_fact, circled_concept, gerund_subject, overview_opener, hover_label,
        enumeration_completeness, vague_quantifier, heading_product_output, defect_framing, internal_disclosure, table_adjacent_block, category_coherence, consequence_order,
        prose_as_table, skip_consequences, diagram_needed, external_values, options_in_code, cross_reference_summary, limitations_coverage, routing_only, unanchored_block,
        unnamed_lead_in, paragraph_cohesion, third_party_ui, over_promise, casual_register, skimmable_sentence, numeric_consistency,
    )
}


def all_candidates(c: Corpus) -> DataFrame:
    return union([g(c) for g in GENERATORS.values()])



