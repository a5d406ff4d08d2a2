"""SQL for DuckDB that states the checks independently of the Spark code.

RE2 knows no look-around, so wording that must not precede or follow a hit is
blanked first; checks that RE2 cannot state this way have no entry.
"""

from __future__ import annotations

from lectern.functions.patterns import any_of, whole_word
from lectern.operators.structure_data import ACRONYMS
from lectern.operators.wordlist_data import WORDLISTS
from lectern.sources.corpora import PAGE_STEPS, derived_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def prefix() -> str:
    """Common tables: ln (all lines), l (body lines outside fences), o (lines outside fences), h (headings)."""
    return f"""WITH RECURSIVE {derived_sql()},
parts AS (SELECT doc_id, path, text, string_split_regex(text, '\\r?\\n') AS a FROM derived),
raws AS (SELECT doc_id, path, unnest(a) AS raw, CAST(unnest(range(1, len(a) + 1)) AS INT) AS line_no, len(a) AS total FROM parts),
fm AS (
  SELECT doc_id, min(line_no) AS front_end FROM raws
  WHERE line_no > 1 AND trim(raw) = '---' AND doc_id IN (SELECT doc_id FROM raws WHERE line_no = 1 AND raw = '---') GROUP BY doc_id
),
marks AS (
  SELECT doc_id, line_no, left(ltrim(bare), 1) AS ch, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k
  FROM (SELECT doc_id, line_no, regexp_replace(raw, '^(\\s*>)+\\s?', '') AS bare FROM raws) WHERE regexp_matches(bare, '^\\s*(```|~~~)')
),
fold AS (
  SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS k, '' AS was, '' AS now FROM marks
  UNION ALL
  SELECT m.doc_id, m.k, f.now, CASE WHEN f.now = '' THEN m.ch WHEN f.now = m.ch THEN '' ELSE f.now END FROM fold f JOIN marks m ON m.doc_id = f.doc_id AND m.k = f.k + 1
),
state AS (SELECT m.doc_id, m.line_no, f.was, f.now FROM marks m JOIN fold f ON f.doc_id = m.doc_id AND f.k = m.k),
ln AS (
  SELECT r.doc_id, r.path, r.line_no, r.raw, r.total, r.line_no > coalesce(fm.front_end, 0) AS is_body,
    coalesce(last_value(s.now IGNORE NULLS) OVER (PARTITION BY r.doc_id ORDER BY r.line_no ROWS UNBOUNDED PRECEDING), '') <> '' OR coalesce(s.was, '') <> '' AS in_fence
  FROM raws r LEFT JOIN fm USING (doc_id) LEFT JOIN state s ON s.doc_id = r.doc_id AND s.line_no = r.line_no
),
o AS (SELECT * FROM ln WHERE NOT in_fence),
l AS (SELECT * FROM o WHERE is_body),
h0 AS (
  SELECT doc_id, line_no, length(regexp_extract(raw, '^ {{0,3}}(#{{1,6}})\\s', 1)) AS level, trim(regexp_extract(raw, '^ {{0,3}}#{{1,6}}\\s+(.+?)\\s*#*\\s*$', 1)) AS text, total
  FROM l WHERE regexp_matches(raw, '^ {{0,3}}#{{1,6}}\\s+(.+?)\\s*#*\\s*$')
),
h AS (
  SELECT a.doc_id, a.line_no, a.level, a.text, coalesce((SELECT min(b.line_no) FROM h0 b WHERE b.doc_id = a.doc_id AND b.line_no > a.line_no AND b.level <= a.level) - 1, a.total) AS end_line
  FROM h0 a
)
"""


def finding(source: str, check: str, tier: int, rule: str, line: str = "line_no", section: str = "CAST(NULL AS VARCHAR)") -> str:
    rule = rule if rule.startswith(("CASE", "x.")) else q(rule)
    return f"SELECT doc_id, CAST({line} AS INT) AS line_no, {tier} AS tier, {rule} AS rule_id, {q(check)} AS check_id, {section} AS section FROM ({source}) x"


NO_CODE = "regexp_replace(raw, '`[^`]*`', ' ', 'g')"
PROSE = f"regexp_replace({NO_CODE}, '\\]\\([^)\\s]*', '](', 'g')"
#: Spans that are not prose, blanked one after another; the test corpus has none that depend on the order.
MASK = NO_CODE
for span in (r"&(?:[a-zA-Z][a-zA-Z0-9]{1,31}|#\d{1,7});", r'(alt|title)="([^"]*)"', r"<[^>]+>", r"\]\([^)]*\)", r"https?://[^\s`<>\"'']+"):
    put = "'>\\2<'" if span.startswith("(alt") else "' '"
    MASK = f"regexp_replace({MASK}, {q(span) if chr(39) * 2 not in span else q(span.replace(chr(39) * 2, chr(39)))}, {put}, 'g')"

#: Entries with look-around: what is blanked before, and the pattern that remains.
PLAIN: dict[str, tuple[str, str]] = {
    r"(?<!\bnot )(?<!\bnever )(?<!n't )(?<!\bnothing but )\bjust\b": (r"(?i)(\bnot |\bnever |n't |\bnothing but )just\b", r"\bjust\b"),
    r"\bany time\b(?! (of|in) )": (r"(?i)\bany time (of|in) ", r"\bany time\b"),
    r"(?<!\bnot )(?<!\bno )\bguarantee[sd]?\b": (r"(?i)\b(not|no) guarantee[sd]?\b", r"\bguarantee[sd]?\b"),
}


def entry_rows(list_name: str, text: str) -> str:
    """doc_id, line_no, entry, rule_id of every line and entry that hits it."""
    cases = []
    for k, (rule, _, phrase, pattern) in enumerate(WORDLISTS[list_name]):
        pattern = pattern or whole_word(phrase or "").replace("\\ ", " ").replace("\\-", "-").replace("\\'", "'")
        said = "said"
        if pattern in PLAIN:
            gone, pattern = PLAIN[pattern]
            said = f"regexp_replace(said, {q(gone)}, ' ', 'g')"
        cases.append(f"CASE WHEN regexp_matches({said}, {q('(?i)' + pattern)}) THEN {q(f'{k:03d}{rule}')} END")
    return f"""SELECT doc_id, line_no, CAST(left(e, 3) AS INT) AS entry, substr(e, 4) AS rule_id FROM (
      SELECT doc_id, line_no, unnest(list_filter([{', '.join(cases)}], lambda e: e IS NOT NULL)) AS e FROM (SELECT doc_id, line_no, {text} AS said FROM l))"""


SENTENCES = r"""(SELECT doc_id, line_no, unnest(list_filter(list_transform(string_split(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(raw, '^\s*(?:[-*+]|\d+\.)\s+', ''), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '`[^`]*`', ' CODE ', 'g'),
  '([.?!])\s+([A-Z`"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS s FROM l WHERE regexp_matches(raw, '\S') AND NOT regexp_matches(raw, %s))"""
WORDS = "len(list_filter(string_split_regex(s, '\\s+'), lambda w: w <> ''))"


def _wordlist(name: str, text: str, check: str, tier: int) -> str:
    return finding(entry_rows(name, text), check, tier, "x.rule_id")


def _named(names: str) -> str:
    return f"(SELECT doc_id, arg_min(line_no, line_no) AS line, arg_min(level, line_no) AS level, arg_min(end_line, line_no) AS end_line FROM h WHERE lower(text) IN ({names}) GROUP BY doc_id)"


LINKS = r"""(SELECT doc_id, line_no, raw, unnest(regexp_extract_all(raw, '\[([^\]]*)\]\(([^)]+)\)', 0)) AS w, unnest(regexp_extract_all(raw, '\[([^\]]*)\]\(([^)]+)\)', 2)) AS url FROM o)"""
ITEMS = r"""(SELECT doc_id, line_no, raw, regexp_extract(raw, '^(\s*)([-*+]|\d+[.)])\s+(.*)$', 3) AS text, regexp_matches(raw, '^\s*\d') AS ordered, length(regexp_extract(raw, '^(\s*)', 1)) AS indent FROM o WHERE regexp_matches(raw, '^(\s*)([-*+]|\d+[.)])\s+(.*)$'))"""


def _acronyms() -> str:
    parts = []
    for a, full in ACRONYMS:
        told = f"regexp_matches(said, {q(rf'\(([^()]*(?:/|,|(?i:\band\b)))?\s*{a}\s*((?:/|,|(?i:\band\b))[^()]*)?\)')}) OR regexp_matches(said, {q(rf'(?i){full}\s*\(')})"
        parts.append(f"SELECT doc_id, {q(a)} AS a, min(CASE WHEN regexp_matches(said, {q(rf'\b{a}\b')}) THEN line_no END) AS used, min(CASE WHEN {told} THEN line_no END) AS told FROM said GROUP BY doc_id")
    return f"WITH said AS (SELECT doc_id, line_no, {NO_CODE} AS said FROM l) SELECT doc_id, used AS line_no FROM ({' UNION ALL '.join(parts)}) WHERE used IS NOT NULL AND (told IS NULL OR told > used)"


SLUGS = r""", h1 AS (SELECT doc_id, line_no, level, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '`([^`]*)`', '\1', 'g'), '\*\*([^*]*)\*\*', '\1', 'g'), '[^\w\s-]', '', 'g'), '\s', '-', 'g') AS slug FROM h),
hs AS (SELECT doc_id, line_no, level, slug || CASE WHEN k > 1 THEN '-' || (k - 1) ELSE '' END AS anchor FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY line_no) AS k FROM h1))"""


def pages_sql() -> str:
    """The derived pages in SQL: relation ``derived(doc_id, path, text)``."""
    text = "coalesce(html, '')"
    for pattern, put in PAGE_STEPS:
        text = f"regexp_replace({text}, {q(pattern)}, {q(put)}, 'g')"
    return f"derived AS (SELECT page_id AS doc_id, 'pages/' || page_id || '.md' AS path, {text} AS text FROM pages)"


def checks() -> dict[str, str]:
    one = lambda where, check, tier, rule, rel="l": finding(f"SELECT * FROM {rel} WHERE {where}", check, tier, rule)
    m = lambda p, text="raw": f"regexp_matches({text}, {q(p)})"
    continuous = r"(?i)\b(?:is|are|was|were|am|be|been)\s+(?:not\s+|never\s+)?(?:only\s+|still\s+|already\s+|currently\s+|now\s+|also\s+|always\s+)?([a-z]+ing)\b"
    states = "missing willing interesting confusing misleading surprising outstanding pending remaining existing matching conflicting promising demanding challenging encouraging appealing binding being".split()
    wordy = any_of([whole_word(p or "").replace("\\ ", " ") for _, _, p, _ in WORDLISTS["wordy"]])
    emoji = "[←-⇿⟰-⟿⤀-⥿⬀-⬑✓-✘❑-❗❬-❵■-◿️🀀-🇥🈁-🏺🐀-🫿‼⁉ℹ⌚⌛☀-★☇-☒☔-⚅⚐-✅✈-✒]"
    parts = {
        "em_dash_semicolon": one(m("[—–;]", MASK), "em-dash-semicolon", 1, "C3-05"),
        "typographic_substitutes": one(m("[·§…×≥≤≠•‣⁃±≈∞]", MASK), "typographic-substitutes", 1, "C3-30"),
        "no_emoji": one(m(emoji, MASK), "no-emoji", 1, "C3-27"),
        "present_continuous": finding(
            f"SELECT doc_id, line_no, unnest(list_filter(regexp_extract_all({NO_CODE}, {q(continuous)}, 1), lambda w: lower(w) NOT IN ({', '.join(map(q, states))}))) AS w FROM l", "present-continuous", 2, "C3-19"),
        "embedded_question_phrases": one(m(r"\S[ \t]how\b", NO_CODE), "embedded-question-phrases", 2, "C3-12"),
        "retry_attempt_count_bold": finding(
            "SELECT doc_id, line_no, unnest(regexp_extract_all(regexp_replace(" + NO_CODE + r", '(?i)\*\*(one|two|three|four|five|six|seven|eight|nine|ten)\s+attempts?\*\*', ' ', 'g'), "
            r"'(?i)\b(?:one|two|three|four|five|six|seven|eight|nine|ten)\s+attempts?\b', 0)) AS w FROM l", "retry-attempt-count-bold", 2, "C3-13"),
        "conditional_framing": one(m(r"(?i)\bif you (see|notice)\b.{0,120}?,\s*(enable|run|use|set|pass|add|remove|check)\b"), "conditional-framing", 2, "C3-29"),
        "additional_resource_phrasing": finding(
            r"SELECT * FROM (SELECT doc_id, line_no, trim(regexp_extract(raw, '^\s*>?\s*\*\*Additional Resources?:\*\*\s*(.*)$', 1)) AS b FROM l WHERE regexp_matches(raw, '^\s*>?\s*\*\*Additional Resources?:\*\*')) "
            r"WHERE NOT (regexp_matches(b, '^For (more information|detailed steps)\b') AND regexp_matches(b, 'refer to the \[[^\]]+\]\([^)]+\)\s+(documentation|section)\b'))", "additional-resource-phrasing", 2, "C5-05"),
        "internal_link_form": one("contains(raw, 'https://www.example.com/docs/') OR contains(raw, 'https://example.com/docs/') OR contains(raw, 'http://www.example.com/docs/') OR contains(raw, 'http://example.com/docs/')", "internal-link-form", 1, "CLI-17"),
        "banned_phrases": _wordlist("banned-phrases", NO_CODE, "banned-phrases", 1),
        "metaphor_phrases": _wordlist("metaphors", NO_CODE, "metaphor-phrases", 2),
        "periphrasis_phrases": _wordlist("periphrasis", NO_CODE, "periphrasis-phrases", 2),
        "over_promise": finding(f"SELECT DISTINCT doc_id, line_no FROM ({entry_rows('over-promise', PROSE)})", "over-promise", 2, "C8-10"),
        "sentence_concision": finding(
            f"SELECT * FROM {SENTENCES % q(r'^\s*(?:#{1,6}\s|\||>)')} WHERE {WORDS} > 28 OR len(regexp_extract_all(s, '(?i)\\b(because|since|so that|so it|therefore)\\b', 0)) >= 2 OR regexp_matches(s, {q('(?i)' + wordy)})",
            "sentence-concision", 2, "C3-07"),
        "skimmable_sentence": finding(
            f"SELECT * FROM (SELECT *, {WORDS} AS n FROM {SENTENCES % q(r'^\s*(?:#{1,6}\s|\||>|!\[|<)')}) WHERE n > 40 OR n > 30 AND (regexp_matches(s, ',[^,]+,[^,]*\\b(?:and|or)\\b') OR "
            r"len(regexp_extract_all(s, '(?i),\s*(?:and|but|so|which|while|whereas)\b|\b(?:as a result|because|so that|which means)\b|\band (?:can|could|will|would|must|may|is|are|was|were|then)\b', 0)) >= 2)",
            "skimmable-sentence", 2, "C2-16"),
        "acronym_first_use": finding(_acronyms(), "acronym-first-use", 1, "C8-07"),
        "bare_domain": one(m(
            r"(?i)(?:^|[^\w@/.:-])(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:com|ai|io|net|org|dev|app|co)(?:$|\.$|[^\w.-]|\.[^a-z0-9])",
            r"regexp_replace(regexp_replace(regexp_replace(" + NO_CODE + r", '!?\[[^\]]*\]\([^)]*\)', ' ', 'g'), '<[^>]+>', ' ', 'g'), 'https?://[^\s)>\]]+', ' ', 'g')"), "bare-domain", 1, "C5-09"),
        "qa_headers": finding(
            "SELECT * FROM h WHERE level > 1 AND suffix(text, '?') AND NOT EXISTS (SELECT 1 FROM h f WHERE f.doc_id = h.doc_id AND lower(f.text) IN ('faq', 'frequently asked questions', 'common questions') AND h.line_no BETWEEN f.line_no AND f.end_line)",
            "qa-headers", 1, "C3-02", section="text"),
        "duplicate_links": finding(f"SELECT doc_id, url, min(line_no) AS line_no FROM {LINKS} GROUP BY doc_id, url HAVING count(*) > 1", "duplicate-links", 2, "C5-04"),
        "prerequisites_links": finding(
            f"SELECT i.doc_id, i.line_no FROM {ITEMS} i JOIN {_named(q('prerequisites'))} p ON p.doc_id = i.doc_id AND i.line_no > p.line AND i.line_no <= p.end_line WHERE NOT EXISTS (SELECT 1 FROM {LINKS} k WHERE k.doc_id = i.doc_id AND k.line_no = i.line_no)",
            "prerequisites-links", 2, "C1-04", section="'Prerequisites'"),
        "bare_links": " UNION ALL ".join(finding(
            f"SELECT k.* FROM {LINKS} k JOIN {_named(q(n.lower()))} p ON p.doc_id = k.doc_id AND k.line_no > p.line AND k.line_no <= p.end_line "
            r"WHERE regexp_matches(raw, '^\s*([-*+]|\d+[.)])\s+') AND (trim(regexp_extract(raw, '^(\s*)([-*+]|\d+[.)])\s+(.*)$', 3)) = w OR regexp_replace(trim(regexp_extract(raw, '^(\s*)([-*+]|\d+[.)])\s+(.*)$', 3)), '[.:]$', '') = w)",
            "bare-links", 1, r, section=q(n)) for n, r in (("Next Steps", "C1-06"), ("Role-Based Routing Table", "RS1-04"), ("Documentation Map", "RS1-04"))),
        "callout_frequency": finding(
            r"SELECT s.doc_id, s.text, min(c.line_no) AS line_no FROM h s JOIN o c ON c.doc_id = s.doc_id AND c.line_no > s.line_no AND c.line_no <= s.end_line WHERE s.level = 2 AND "
            r"regexp_matches(c.raw, '(?i)^\s*(\*\*)?(ATTENTION|Required|Note|Additional Resource)(\*\*)?\s*:') GROUP BY s.doc_id, s.line_no, s.text HAVING count(*) > 1", "callout-frequency", 2, "C2-05", section="text"),
        "troubleshooting_format": " UNION ALL ".join(finding(
            f"SELECT * FROM (SELECT e.doc_id, e.line_no, e.text, string_agg(l2.raw, chr(10) ORDER BY l2.line_no) AS b FROM {_named(q('troubleshooting'))} t JOIN h e ON e.doc_id = t.doc_id AND e.line_no > t.line AND e.end_line <= t.end_line AND e.level = t.level + 1 "
            "LEFT JOIN ln l2 ON l2.doc_id = e.doc_id AND l2.line_no > e.line_no AND l2.line_no <= e.end_line GROUP BY e.doc_id, e.line_no, e.text) WHERE " + where, "troubleshooting-format", 1, "C1-05", section="text")
            for where in (
                r"NOT coalesce(regexp_matches(b, '\*\*Root Causes?\*\*'), false)", "NOT coalesce(contains(b, '**Resolution**'), false)",
                "instr(b, '**Root Cause') > instr(b, '**Resolution**') AND instr(b, '**Resolution**') > 0",
            )),
        "heading_length": " UNION ALL ".join([
            finding("SELECT * FROM hh WHERE odd", "heading-length", 1, "C2-08"),
            finding("SELECT * FROM hh WHERE NOT odd AND n > 4 AND NOT (coalesce(entry, false) AND output)", "heading-length", 2, "C2-07"),
        ]),
        "anchor_heading_level": finding(
            f"SELECT k.doc_id, k.line_no FROM {LINKS} k JOIN hs ON hs.doc_id = k.doc_id AND '#' || hs.anchor = k.url WHERE hs.level > 3", "anchor-heading-level", 1, "C5-08"),
    }
    more = {
        "heading_length": r""", hh AS (SELECT doc_id, line_no,
  (regexp_matches(text, '^[a-z]') AND NOT regexp_matches(text, '^(?:[a-z0-9]+[-_][a-z0-9-_]+|[a-z]+\.[a-z]+|npx|npm|node|stdio)\b') AND NOT regexp_matches(text, '^(?:[a-z]+[A-Z][A-Za-z0-9]*|[a-z][\w.]*\(|[a-z][\w-]*$)'))
  OR (regexp_matches(text, '^(?:And|But|Or|Nor|So|Because|Which|Whereas|Unless|Although|Though)\b') AND regexp_matches(text, '\s')) AS odd,
  len(list_filter(string_split_regex(regexp_replace(text, '`[^`]+`', 'X', 'g'), '\s+'), lambda w: w <> '')) AS n,
  suffix(text, '.') OR regexp_matches(text, '<[A-Z_]+>') OR regexp_matches(text, '"[a-z_]+"|`[a-z_]+`') AS output,
  (SELECT regexp_matches(arg_min(o.raw, o.line_no), '^\s*\*\*Root Cause\*\*') FROM o WHERE o.doc_id = h.doc_id AND o.line_no > h.line_no AND regexp_matches(o.raw, '\S')) AS entry
  FROM h WHERE level > 1)""",
        "anchor_heading_level": SLUGS,
    }
    return {f"check_{name}": prefix() + more.get(name, "") + sql for name, sql in parts.items()}


#: Links as the link layers read them: any fence line toggles, code is blanked.
STRICT_LINKS = r""", tl AS (SELECT doc_id, unnest(a) AS raw, CAST(unnest(range(1, len(a) + 1)) AS INT) AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM derived)),
tm AS (SELECT *, regexp_matches(regexp_replace(raw, '^(\s*>)+\s?', ''), '^\s*(```|~~~)') AS mark FROM tl),
ts AS (SELECT doc_id, line_no, regexp_replace(raw, '`[^`\n]*`', ' ', 'g') AS scan FROM (SELECT *, sum(CAST(mark AS INT)) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM tm) WHERE NOT mark AND n % 2 = 0),
ta AS (
  SELECT doc_id, line_no, regexp_extract_all(scan, '(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\s*(?:"[^"]*")?\)', 1) AS bang, regexp_extract_all(scan, '(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\s*(?:"[^"]*")?\)', 2) AS label, regexp_extract_all(scan, '(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\(([^()\s]*(?:\([^()]*\)[^()\s]*)*)\s*(?:"[^"]*")?\)', 3) AS target,
    regexp_extract_all(scan, '(?i)<a\s[^>]*href\s*=\s*"([^"]*)"', 1) AS href
  FROM ts
),
tu AS (
  SELECT doc_id, line_no, unnest(range(0, len(label))) AS ord, unnest(label) AS label, unnest(target) AS target, unnest(bang) = '!' AS image, false AS html FROM ta
  UNION ALL SELECT doc_id, line_no, len(label) + unnest(range(0, len(href))), '', unnest(href), false, true FROM ta
),
strict AS (
  SELECT doc_id, line_no, CAST(ord AS INT) AS ord, label, target, image, html, CASE WHEN regexp_matches(target, '(?i)^https?://') THEN 'external'
    WHEN regexp_matches(target, '(?i)^(mailto|tel|data|javascript):') THEN 'scheme' WHEN starts_with(target, '//') THEN 'external' WHEN starts_with(target, '#') THEN 'same-page' ELSE 'relative' END AS kind FROM tu
)"""


def relations() -> dict[str, str]:
    return {
        "lines": prefix() + "SELECT doc_id, line_no, md5(raw) AS raw_md5, in_fence, is_body FROM ln",
        "headings": prefix() + "SELECT doc_id, line_no, CAST(level AS INT) AS level, text, CAST(end_line AS INT) AS end_line FROM h",
        "links": prefix() + f"SELECT doc_id, line_no, url FROM {LINKS}",
        "sentences": prefix() + "SELECT doc_id, line_no, CAST(unnest(range(0, len(a))) AS INT) AS ord, md5(unnest(a)) AS sentence_md5 FROM "
        + (SENTENCES % q(r'^\s*(?:#{1,6}\s|\||>)')).replace("unnest(list_filter(", "list_filter(", 1).replace("lambda s: s <> '')) AS s", "lambda s: s <> '') AS a"),
        "strict_links": f"WITH {derived_sql()}{STRICT_LINKS} SELECT doc_id, line_no, ord, label, target, image, html, kind FROM strict",
        "link_counts": f"WITH {derived_sql()}{STRICT_LINKS} SELECT kind, count(*) AS links, count(*) FILTER (image) AS images, count(*) FILTER (html) AS html_links FROM strict GROUP BY kind",
        "anchors": prefix() + SLUGS + "SELECT doc_id, line_no, anchor FROM hs",
        "fences": prefix() + r""", marked AS (
  SELECT s.doc_id, s.line_no, s.was, s.now, trim(regexp_extract(regexp_replace(r.raw, '^(\s*>)+\s?', ''), '^(\s*)(`{3,}|~{3,})(.*)$', 3)) AS lang, r.total
  FROM state s JOIN raws r ON r.doc_id = s.doc_id AND r.line_no = s.line_no
),
f AS (SELECT doc_id, line_no AS a, lang, coalesce((SELECT min(c.line_no) FROM marked c WHERE c.doc_id = m.doc_id AND c.line_no > m.line_no AND c.now = ''), total) AS b FROM marked m WHERE was = '' AND now <> '')
SELECT f.doc_id, CAST(a AS INT) AS start_line, CAST(b AS INT) AS end_line, lang,
  coalesce((SELECT string_agg(raw, chr(10) ORDER BY r.line_no) FROM raws r WHERE r.doc_id = f.doc_id AND r.line_no > a AND r.line_no < b), '') AS body FROM f""",
        "page_headings": prefix().replace(derived_sql(), pages_sql()) + "SELECT doc_id, line_no, CAST(level AS INT) AS level, text FROM h",
        "list_items": prefix() + f"SELECT doc_id, line_no, CAST(indent AS INT) AS indent, ordered, text FROM {ITEMS}",
    }


def flagship() -> str:
    """Present continuous on the raw documents, rolled up by rule."""
    words = ", ".join(map(q, "missing willing interesting confusing misleading surprising outstanding pending remaining existing matching conflicting promising demanding challenging encouraging appealing binding being".split()))
    return rf"""WITH lines AS (SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS raw FROM documents),
hits AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(regexp_replace(raw, '`[^`]*`', ' ', 'g'),
  '(?i)\b(?:is|are|was|were|am|be|been)\s+(?:not\s+|never\s+)?(?:only\s+|still\s+|already\s+|currently\s+|now\s+|also\s+|always\s+)?([a-z]+ing)\b', 1), lambda w: lower(w) NOT IN ({words}))) AS w FROM lines)
SELECT 'C3-19' AS rule_id, 2 AS tier, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM hits HAVING count(*) > 0"""


#: Rows of the rollup queries in SQL: the union of the same checks.
LINE_CHECKS = [
    "em_dash_semicolon", "present_continuous", "embedded_question_phrases", "retry_attempt_count_bold", "conditional_framing", "additional_resource_phrasing",
    "internal_link_form", "typographic_substitutes", "no_emoji", "sentence_concision", "skimmable_sentence", "over_promise", "bare_domain", "qa_headers", "duplicate_links",
]


def rollups(texts: list[tuple[str, str]]) -> dict[str, str]:
    start = prefix()
    bodies = checks()
    every = " UNION ALL ".join(f"({bodies[f'check_{n}'].removeprefix(start)})" for n in LINE_CHECKS)
    classed = f""", every AS ({every}),
    classes AS (SELECT doc_id, CASE WHEN starts_with(path, 'docs/prompts/') THEN 'agent-prompt' WHEN starts_with(path, 'docs/') THEN 'published' ELSE 'internal' END AS class FROM derived),
    kept AS (SELECT e.* FROM every e JOIN classes c USING (doc_id) WHERE NOT (c.class <> 'published' AND e.rule_id IN ('FM-01', 'FM-02', 'C1-01', 'C1-02', 'MIG-02', 'C2-04')))
    """
    return {
        "rollup_by_rule": start + classed + "SELECT rule_id, check_id, tier, count(*) AS findings, count(DISTINCT doc_id) AS documents FROM kept GROUP BY rule_id, check_id, tier",
        "corpus_summary": start + classed + """SELECT count(*) AS files, count(*) FILTER (coalesce(e, 0) + coalesce(w, 0) = 0) AS clean, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors,
          CAST(coalesce(sum(w), 0) AS BIGINT) AS warnings, coalesce(sum(e), 0) = 0 AS passed
          FROM derived LEFT JOIN (SELECT doc_id, count(*) FILTER (tier = 1) AS e, count(*) FILTER (tier = 2) AS w FROM kept GROUP BY doc_id) USING (doc_id)""",
        "first_tier_findings": start + classed + "SELECT doc_id, line_no, rule_id, check_id FROM every WHERE tier = 1",
        "rule_text_rollup": start + classed + f"SELECT rule_id, coalesce(t, '(not in registry)') AS rule, count(*) AS findings FROM every LEFT JOIN (VALUES {', '.join(f'({q(k)}, {q(t)})' for k, t in texts)}) AS r(k, t) ON k = rule_id GROUP BY ALL",
    }


def candidates() -> dict[str, str]:
    """Candidate generators that read one line of an H2 section, or a whole document."""
    start = prefix()
    home = "(SELECT o.doc_id, o.line_no, o.raw, trim(o.raw) AS said, h.text AS section FROM o JOIN h ON h.doc_id = o.doc_id AND h.level = 2 AND o.line_no BETWEEN h.line_no AND h.end_line)"
    row = lambda sql, gen, rule, also, section="section": f"SELECT doc_id, CAST(line_no AS INT) AS line_no, {q(rule)} AS rule_id, {q(also)} AS also_covers, {q(gen)} AS generator, {section} AS section FROM ({sql})"
    title = "(SELECT d.doc_id, coalesce(t.line_no, coalesce(fm.front_end, 0) + 1) AS line_no, t.text AS section FROM derived d LEFT JOIN fm USING (doc_id) LEFT JOIN (SELECT doc_id, arg_min(text, line_no) AS text, min(line_no) AS line_no FROM h WHERE level = 1 GROUP BY doc_id) t USING (doc_id))"
    m = lambda p, c="raw": f"regexp_matches({c}, {q(p)})"
    parts = {
        "defect_framing": row(f"SELECT * FROM {home} WHERE " + m(r"(?i)\b(silently|quietly|misleading|does nothing|has no effect|not supported yet|no warning|without warning|no counter)\b"), "defect_framing", "C8-09", ""),
        "internal_disclosure": row(f"SELECT * FROM {home} WHERE " + m(r"(?i)\b(internal to the app|fails? open|serves every|short-lived token|POST\s+/api/|PUT\s+/api/|\.ts:\d+|\.tsx:\d+|lib/[a-z-]+/)\b"), "internal_disclosure", "C6-04", ""),
        "hover_label": row(f"SELECT * FROM {home} WHERE NOT " + m(r"^(?:\||#{1,6}\s)", "said") + " AND " + m(r"(?i)\b(hovers?|hovering|icons?|reveals?)\b", "said") + " AND " + m(r"\*\*[^*]*[^*\s][^*]*\*\*", "said"), "hover_label", "C4-08", ""),
        "limitations_coverage": row(f"SELECT * FROM {title} t WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = t.doc_id AND lower(h.text) = 'limitations')", "limitations_coverage", "C9-04", ""),
        "routing_only": row(f"SELECT * FROM {title}", "routing_only", "C4-06", "") + " UNION ALL " + row(f"SELECT * FROM {title}", "routing_only", "C7-03", ""),
        "enumeration_completeness": row(f"SELECT * FROM {home} WHERE NOT " + m(r"(?i)\b(for example|such as|among (?:them|others)|including)\b") + " AND " + m(
            r"(?i)\b(change|edit|update|modify|configure|set|adjust|rename)\s+(?:its|the|your|their)?\s*([a-z][\w-]*(?:,\s*[a-z][\w-]*)*\s+(?:or|and)\s+[a-z][\w-]*)\b", NO_CODE), "enumeration_completeness", "C3-16", ""),
    }
    return {f"candidates_{k}": start + v for k, v in parts.items()}
