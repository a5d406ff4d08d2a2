"""Checks that read one line, or one sentence of a line, at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.patterns import any_of, spark
from lectern.functions.relations import Corpus
from lectern.functions.scalars import emphasis_mask, prose_mask, readable, sentences, status_codes_in, without_code, word_count
from lectern.operators.findings import finding, union
from lectern.operators.structure_data import ACRONYMS
from lectern.operators.wordlist_data import WORDLISTS
from lectern.operators.wordlists import pattern_of


def em_dash_semicolon(c: Corpus) -> DataFrame:
    some = c.may("dash").where(F.col("raw").rlike("[—–;]"))
    return finding(some.where(prose_mask("raw").rlike("[—–;]")), "em-dash-semicolon", 1, "C3-05")


#: Fixed values: -ing words that describe a state.
STATES = "missing willing interesting confusing misleading surprising outstanding pending remaining existing matching conflicting promising demanding challenging encouraging appealing binding".split()
CONTINUOUS = r"\b(is|are|was|were|am|be|been)\s+(?:not\s+|never\s+)?(?:only\s+|still\s+|already\s+|currently\s+|now\s+|also\s+|always\s+)?([a-z]+ing)\b"


def present_continuous_hits(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, ord, hit: every 'be ...ing' but states and 'being'."""
    found = F.regexp_extract_all(without_code(F.col("raw")), F.lit(spark(CONTINUOUS, ignore_case=True)), 2)
    rows = lines.where(F.col("raw").rlike("(?i)ing")).select("doc_id", "line_no", F.posexplode(F.transform(found, F.lower)).alias("ord", "hit"))
    return rows.where(~F.col("hit").isin([*STATES, "being"]))


def present_continuous(c: Corpus) -> DataFrame:
    return finding(present_continuous_hits(c.may("continuous")), "present-continuous", 2, "C3-19")


def error_code_format(c: Corpus) -> DataFrame:
    some = c.may("number").where(F.col("raw").rlike("[1-5][0-9]{2}"))
    return finding(some.where(F.size(status_codes_in("raw")) > 0), "error-code-format", 1, "C3-11")


def embedded_question(c: Corpus) -> DataFrame:
    hit = without_code(F.col("raw")).rlike(spark(r"(?<=\S[ \t])how\b"))
    return finding(c.may("how").where(hit), "embedded-question-phrases", 2, "C3-12")


def retry_attempt_bold(c: Corpus) -> DataFrame:
    """One finding for every spelled attempt count that is not in bold."""
    said = F.regexp_replace("raw", "`[^`]*`", "``")  # no count can join across code
    count = r"\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\s+attempts?\b"
    found = F.regexp_extract_all(said, F.lit(spark(rf"((?:\*\*)?{count}(?:\*\*)?)", ignore_case=True)), 1)
    rows = c.may("attempt").where(F.col("raw").rlike("(?i)attempt")).select("doc_id", "line_no", F.explode(found).alias("hit"))
    return finding(rows.where(~(F.col("hit").startswith("**") & F.col("hit").endswith("**"))), "retry-attempt-count-bold", 2, "C3-13")


def conditional_framing(c: Corpus) -> DataFrame:
    hit = F.col("raw").rlike(spark(r"\bif you (see|notice)\b.{0,120}?,\s*(enable|run|use|set|pass|add|remove|check)\b", ignore_case=True))
    return finding(c.may("conditional").where(hit), "conditional-framing", 2, "C3-29")


#: Characters written where words belong, and pictographs.
SUBSTITUTES = "[·§…×≥≤≠•‣⁃±≈∞]"
ARROWS_AND_MARKS = r"\x{2190}-\x{21FF}\x{27F0}-\x{27FF}\x{2900}-\x{297F}\x{2B00}-\x{2B11}\x{2713}-\x{2718}\x{2751}-\x{2757}\x{276C}-\x{2775}\x{25A0}-\x{25FF}\x{FE0F}"
PICTOGRAPHS = (
    r"\x{203C}\x{2049}\x{2139}\x{231A}\x{231B}\x{2328}\x{2388}\x{23CF}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{24C2}\x{2600}-\x{2605}\x{2607}-\x{2612}\x{2614}-\x{2685}"
    r"\x{2690}-\x{2705}\x{2708}-\x{2712}\x{2714}\x{2716}\x{271D}\x{2721}\x{2728}\x{2733}\x{2734}\x{2744}\x{2747}\x{274C}\x{274E}\x{2753}-\x{2755}\x{2757}\x{2763}-\x{2767}"
    r"\x{2795}-\x{2797}\x{27A1}\x{27B0}\x{27BF}\x{2934}\x{2935}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F000}-\x{1F1E5}"
    r"\x{1F201}-\x{1F3FA}\x{1F400}-\x{1FAFF}"
)


def typographic_substitutes(c: Corpus) -> DataFrame:
    some = c.may("substitutes").where(F.col("raw").rlike(SUBSTITUTES))
    return finding(some.where(prose_mask("raw").rlike(SUBSTITUTES)), "typographic-substitutes", 1, "C3-30")


def no_emoji(c: Corpus) -> DataFrame:
    pattern = f"[{ARROWS_AND_MARKS}{PICTOGRAPHS}]"
    some = c.may("emoji").where(F.col("raw").rlike(pattern))
    return finding(some.where(prose_mask("raw").rlike(pattern)), "no-emoji", 1, "C3-27")


STAR = spark(r"(?<![*\w])\*(?!\s)(?!\*)([^*\n]+?)(?<!\s)\*(?!\*)")
LOW_LINE = spark(r"(?<![A-Za-z0-9_\\])_(?!\s)(?!_)([^_\n]+?)(?<!\s)_(?![A-Za-z0-9_])")
WIDE_STAR = spark(r"(?<![*\w])\*(?!\s)(?!\*)((?:[^*\n]|\*\*|\n(?!\n))+?)(?<!\s)\*(?!\*)")
ITALIC_TAG = spark(r"</?(?:em|i)(?:\s[^>]*)?>", ignore_case=True)


def no_italics(c: Corpus) -> DataFrame:
    """Italics on a line; then spans over several lines or around bold, once per paragraph not reported yet."""
    spot = c.may("emphasis").where(F.col("raw").rlike("[*_]|</?(?i:em|i)\\b")).withColumn("m", emphasis_mask("raw"))
    own = spot.where(F.col("m").rlike(STAR) | F.col("m").rlike(LOW_LINE) | F.col("raw").rlike(ITALIC_TAG)).select("doc_id", "line_no")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    blank = ~F.col("raw").rlike(spark(r"\S")) | F.col("in_fence")
    marked = c.only("open star").every_line.where("is_body").withColumn("gap", blank).withColumn("para", F.sum(F.col("gap").cast("int")).over(order))
    text = marked.where("not gap").withColumn("m", emphasis_mask("raw")).groupBy("doc_id", "para").agg(
        F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "m"))), lambda x: x["m"]), "\n").alias("m")
    )
    spans = F.filter(F.regexp_extract_all("m", F.lit(f"({WIDE_STAR})"), 1), lambda s: s.contains("\n") | s.contains("**"))
    wide = text.where(F.col("m").contains("*")).where(F.size(spans) > 0).select("doc_id", "line_no").join(own, ["doc_id", "line_no"], "left_anti")
    return finding(own.union(wide), "no-italics", 1, "C3-28")


#: Labels of callouts.
CALLOUTS = ["warning", "note", "tip", "additional resource", "additional resources", "before you begin"]


def callout_taxonomy(c: Corpus, cli_docs: DataFrame) -> DataFrame:
    """Callout labels outside the set; in docs about the command line, colons outside the bold."""
    inside, outside = spark(r"^>\s*\*\*([^*:]+):\*\*"), spark(r"^>\s*\*\*([^*:]+)\*\*\s*:")
    rows = c.may("quote").where(F.col("raw").startswith(">")).select("doc_id", "line_no", F.regexp_extract("raw", inside, 1).alias("a"), F.regexp_extract("raw", outside, 1).alias("b"))
    label = F.lower(F.trim(F.when(F.col("a") != "", F.col("a")).otherwise(F.col("b"))))
    some = rows.where("a <> '' or b <> ''")
    wrong = finding(some.where(~label.isin(CALLOUTS)), "callout-taxonomy", 1, "C2-11")
    loose = some.where("a = ''").join(cli_docs, "doc_id", "left_semi")
    return union([wrong, finding(loose, "callout-taxonomy", 2, "CLI-09")])


def additional_resource(c: Corpus) -> DataFrame:
    callout = spark(r"^\s*>?\s*\*\*Additional Resources?:\*\*\s*(.*)$")
    body = F.trim(F.regexp_extract("raw", callout, 1))
    good = body.rlike(spark(r"^For (?:more information|detailed steps)\b")) & body.rlike(spark(r"refer to the \[[^\]]+\]\([^)]+\)\s+(documentation|section)\b"))
    return finding(c.may("additional").where(F.col("raw").rlike(callout) & ~good), "additional-resource-phrasing", 2, "C5-05")


#: Endings of names that are read as domains.
TLDS = "com|ai|io|net|org|dev|app|co"
DOMAIN = spark(rf"(?<![\w@/.:-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:{TLDS})(?![\w-]|\.[a-z0-9])", ignore_case=True)


def bare_domain(c: Corpus) -> DataFrame:
    blanked = F.col("raw")
    for span in ("`[^`]*`", r"!?\[[^\]]*\]\([^)]*\)", "<[^>]+>", spark(r"https?://[^\s)>\]]+")):
        blanked = F.regexp_replace(blanked, span, " ")
    return finding(c.may("domain").where(F.col("raw").contains(".")).where(blanked.rlike(DOMAIN)), "bare-domain", 1, "C5-09")


#: The documentation site, unless a call names another.
DOCS_SITE = r"https?://(?:www\.)?example\.com/docs/"


def internal_link_form(c: Corpus, docs_site: str = DOCS_SITE) -> DataFrame:
    """Absolute links into the documentation site itself, which is a parameter."""
    return finding((c.may("docs site") if docs_site == DOCS_SITE else c.lines).where(F.col("raw").rlike(docs_site)), "internal-link-form", 1, "CLI-17")


#: Wording that asks for a click.
CUE = (
    r"\b(tabs?|buttons?|menus?|menu items?|screens?|panels?|fields?|sections?|badges?|icons?|actions?|columns?|dialogs?|modals?|toggles?|checkboxes?|dropdowns?|"
    r"statuses|status|wizard|clicks?|selects?|hovers?|opens?|choose|chooses)\b"
)


def ui_element_bold(c: Corpus) -> DataFrame:
    """Names of screen elements set in code on a line, or in a table, that speaks of the screen."""
    cued = c.tables.where(F.array_join("header", " ").rlike(spark(CUE, ignore_case=True))).select("doc_id", F.explode(F.sequence("start_line", "end_line")).alias("line_no")).distinct().withColumn("cued", F.lit(True))
    labels = F.filter(F.transform(F.regexp_extract_all("raw", F.lit("`([^`]+)`"), 1), F.trim), lambda x: x.rlike(r"^[A-Z][A-Za-z0-9]*(?: [A-Za-z0-9]+){0,3}\z") & x.rlike("[a-z]"))
    rows = c.may("code").where(F.col("raw").contains("`")).where(F.size(labels) > 0).join(cued, ["doc_id", "line_no"], "left")
    return finding(rows.where(F.col("raw").rlike(spark(CUE, ignore_case=True)) | F.col("cued")), "ui-element-bold", 2, "C4-07")


def acronym_first_use(c: Corpus) -> DataFrame:
    """Acronyms whose first bare use comes before, or without, an expansion."""
    said = c.may("acronym").withColumn("said", without_code(F.col("raw")))
    groups = F.flatten(F.transform(F.regexp_extract_all("said", F.lit(r"\(([^()]+)\)"), 1), lambda g: F.transform(F.split(g, spark(r"\s*(?:/|,|\band\b)\s*", ignore_case=True)), F.trim)))
    each = F.array(*[
        F.struct(
            F.lit(a).alias("acronym"), F.col("said").rlike(spark(rf"\b{a}\b")).alias("used"),
            (F.array_contains(groups, a) | F.col("said").rlike(spark(rf"{full}\s*\(", ignore_case=True))).alias("told"),
        )
        for a, full in ACRONYMS
    ])
    quick = F.col("said").rlike(any_of([a for a, _ in ACRONYMS])) | F.col("said").rlike(spark(any_of([f for _, f in ACRONYMS]), ignore_case=True))
    rows = said.where(quick).select("doc_id", "line_no", F.explode(F.filter(each, lambda x: x["used"] | x["told"])).alias("x"))
    first = rows.groupBy("doc_id", "x.acronym").agg(F.min(F.when(F.col("x.used"), F.col("line_no"))).alias("line_no"), F.min(F.when(F.col("x.told"), F.col("line_no"))).alias("told"))
    return finding(first.where("line_no is not null and (told is null or told > line_no)"), "acronym-first-use", 1, "C8-07")


def sentence_rows(c: Corpus, skip: str, *sieves: str) -> DataFrame:
    """doc_id, line_no, ord, sentence of lines (that may pass ``sieves``) that do not open as ``skip`` says."""
    some = c.may(*sieves).where(F.col("raw").rlike(spark(r"\S")) & ~F.col("raw").rlike(spark(skip)))
    return some.select("doc_id", "line_no", F.posexplode(sentences(readable(F.col("raw")))).alias("ord", "sentence"))


def sentence_concision(c: Corpus) -> DataFrame:
    rows = sentence_rows(c, r"^\s*(?:#{1,6}\s|\||>)", "concision")
    wordy = F.col("sentence").rlike(spark(any_of([pattern_of(e) for e in WORDLISTS["wordy"]]), ignore_case=True))
    causes = F.regexp_count("sentence", F.lit(spark(r"\b(because|since|so that|so it|therefore)\b", ignore_case=True)))
    return finding(rows.where((word_count(F.col("sentence")) > 28) | (causes >= 2) | wordy), "sentence-concision", 2, "C3-07")


def skimmable_sentence(c: Corpus) -> DataFrame:
    rows = sentence_rows(c, r"^\s*(?:#{1,6}\s|\||>|!\[|<)", "skimmable")
    n = word_count(F.col("sentence"))
    series = F.col("sentence").rlike(spark(r",[^,]+,[^,]*\b(?:and|or)\b"))
    joins = F.regexp_count("sentence", F.lit(spark(
        r",\s*(?:and|but|so|which|while|whereas)\b|\b(?:as a result|because|so that|which means)\b|\band (?:can|could|will|would|must|may|is|are|was|were|then)\b", ignore_case=True)))
    return finding(rows.where((n > 40) | ((n > 30) & (series | (joins >= 2)))), "skimmable-sentence", 2, "C2-16")


#: Products of others, their help sites and plans, and references that stay allowed.
VENDORS = ["ChatGPT", "OpenAI", "Codex", "Claude Desktop", "Claude Code", "Claude", "Anthropic", "Cursor", "VS Code", "Visual Studio Code", "GitHub Copilot", "Copilot", "Gemini", "Windsurf"]
HELP_HOSTS = [
    "help.openai.com", "support.claude.com", "support.anthropic.com", "docs.cursor.com", "cursor.com/docs", "forum.cursor.com", "code.visualstudio.com/docs",
    "docs.github.com/en/copilot", "support.google.com/gemini", "docs.windsurf.com",
]
PLANS = "Free|Plus|Pro|Team|Teams|Enterprise|Business|Max|Edu"
ALLOWED_HOSTS = ["modelcontextprotocol.io", "nodejs.org", "npmjs.com", "www.npmjs.com", "registry.npmjs.org"]
MENU_PATHS = [
    r"\*\*[^*]+?\s(?:>|→|›|->)\s[^*]+?\*\*", r"\*\*[^*]+\*\*\s*(?:>|→|›|->)\s*\*\*[^*]+\*\*", r"\b[A-Z][\w-]*(?: [A-Z][\w-]*)*\s(?:>|→|›)\s[A-Z][\w-]*",
]
HOUSE_BOLD = r"[:.]\s*$|^(?i:Note|Tip|Warning|Important|Additional Resources?|Root Causes?|Possible causes?|Resolution|Applies to)\b"


def vendor_lines(c: Corpus) -> DataFrame:
    """Non-blank body lines with ``vendor``: named on the line, in its innermost section's title, or up to 4 lines back.

    Only documents that name a vendor anywhere, if a sieve can tell: no line of others has one.
    """
    c = c.only("vendor")
    name = spark(rf"\b(?:{'|'.join(VENDORS)})\b")
    blank = F.regexp_replace("raw", "`[^`]*`", " ")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    back = order.rowsBetween(-4, -1)
    heading = F.col("raw").rlike(spark(r"^\s*#{1,6}\s"))
    rows = c.every_line.withColumn("names", blank.rlike(name)).withColumn("stop", heading)
    rows = rows.withColumn("near", F.max(F.when(F.col("names") & ~F.col("stop") & F.col("is_body"), F.col("line_no"))).over(back))
    rows = rows.withColumn("fence_off", F.max(F.when(F.col("stop"), F.col("line_no"))).over(back))
    titles = c.headings.select("doc_id", "line_no", "end_line", F.regexp_replace("text", "`[^`]*`", " ").rlike(name).alias("titled"))
    named = titles.select("doc_id", F.explode(F.when(F.col("end_line") >= F.col("line_no"), F.sequence("line_no", "end_line"))).alias("line_no"), F.col("line_no").alias("start"), "titled")
    inner = named.groupBy("doc_id", "line_no").agg(F.max_by("titled", "start").alias("titled"))
    joined = rows.where("is_body and not in_fence").where(F.col("raw").rlike(spark(r"\S"))).join(inner, ["doc_id", "line_no"], "left")
    vendor = F.col("names") | F.coalesce("titled", F.lit(False)) | F.coalesce((F.col("near") > F.coalesce("fence_off", F.lit(0))), F.lit(False))
    return joined.withColumn("vendor", vendor).withColumn("said", F.regexp_replace(blank, r"\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)", "[$1]"))


def third_party_ui(c: Corpus) -> DataFrame:
    lines = c.may("link").where(F.col("raw").contains("]("))
    urls = lines.select("doc_id", "line_no", F.explode(F.regexp_extract_all("raw", F.lit(spark(r"\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)")), 2)).alias("url"))
    bare = F.regexp_replace(F.regexp_replace("url", r"(?i)^https?://", ""), r"(?i)^www\.", "")
    begins = lambda hosts, ends: F.array_contains(F.array(*[(bare == h) | (F.startswith(bare, F.lit(h + "/"))) | (F.startswith(bare, F.lit(h + "?")) if ends else F.lit(False)) for h in hosts]), True)
    help_links = urls.where(begins(HELP_HOSTS, True) & ~begins(ALLOWED_HOSTS, False))
    vendor = vendor_lines(c).where("vendor")
    menu = F.col("said").rlike(spark(any_of(MENU_PATHS)))
    name = rf"\b(?:{'|'.join(VENDORS)})\b"
    plan = F.col("said").rlike(spark(rf"\b(?:{'|'.join(VENDORS)})\s+(?:{PLANS})\b|\b(?:{PLANS}) plan\b"))
    bold = F.filter(F.transform(F.regexp_extract_all("said", F.lit(r"\*\*([^*]+)\*\*"), 1), F.trim), lambda b: ~b.rlike(spark(HOUSE_BOLD)) & ~b.rlike(spark(name)))
    calm = vendor.where(~menu)
    return union([
        finding(help_links, "third-party-ui", 1, "C5-07"),
        finding(vendor.where(menu), "third-party-ui", 1, "C5-07"),
        finding(calm.where(plan), "third-party-ui", 2, "C4-09"),
        finding(calm.select("doc_id", "line_no", F.explode(bold)), "third-party-ui", 2, "C4-09"),
    ])
