"""Deterministic rewrites of single lines, and checks that an edit kept what it must keep.

Rewrites never change their input: they give (doc_id, line_no, before, after,
rules, clean).  Each family is a list of small rules tried in order until no
offence is left, four passes at most.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.relations import Corpus
from lectern.functions.scalars import cell_spans, masked, over_budget, row_faults, slug
from lectern.operators.structure_data import ACRONYMS

Rule = tuple[str, Callable[[str], str]]

_DASH = re.compile("[—–;]")
_ROW = re.compile(r"^\s*\|")


def _bars(line: str) -> int:
    open_line = masked(line, " ", said=False)
    return sum(1 for i, c in enumerate(open_line) if c == "|" and line[i] == "|" and (i == 0 or line[i - 1] != "\\"))


def dash_offends(line: str) -> bool:
    return bool(_DASH.search(masked(line)))


def heading_colon(line: str) -> str:
    """A heading with one spaced dash and no colon gets a colon for the dash."""
    m = re.match(r"^(#{1,6}\s+)(.*?)\s+[—–]\s+(.*)$", line)
    if not m or ":" in line or len(re.findall("[—–]", masked(line))) != 1:
        return line
    return f"{m[1]}{m[2]}: {m[3]}"


def bold_label_colon(line: str) -> str:
    return re.sub(r"^(\s*(?:[-*+]|\d+\.)\s+)?(\*\*[^*]+\*\*)\s+[—–]\s+(\S.*)$", lambda m: f"{m[1] or ''}{m[2]}: {m[3]}", line)


def paired_dashes(line: str) -> str:
    """Exactly two spaced dashes around a short, self-contained aside become parentheses."""
    if _ROW.match(line):
        return line
    found = list(re.finditer(r"\s+[—–]\s+", masked(line)))
    if len(found) != 2:
        return line
    a, b = found
    inner, tail = line[a.end() : b.start()], line[b.end() :]
    shape = masked(inner)
    balanced = (
        "|" not in shape and shape.count("(") == shape.count(")") and shape.count("[") == shape.count("]") and shape.count('"') % 2 == 0
        and shape.count("'") % 2 == 0 and shape.count("**") % 2 == 0
    )
    if not inner.strip() or not tail.strip() or len(inner) > 60 or _DASH.search(shape) or not balanced:
        return line
    return f"{line[: a.start()]} ({inner}) {tail}"


def range_to(line: str) -> str:
    """An en dash between two numbers, or two letters, becomes 'to'."""
    out = line
    for m in reversed(list(re.finditer(r"(?<![A-Za-z0-9_])([0-9]{1,3}|[A-Za-z][0-9]{0,2})\s*–\s*([0-9]{1,3}|[A-Za-z][0-9]{0,2})", masked(line)))):
        if m[1].isdigit() == m[2].isdigit():
            out = f"{out[: m.start()]}{m[1]} to {m[2]}{out[m.end() :]}"
    return out


def semicolon_sentence(line: str) -> str:
    """One semicolon before a lower-case clause of two words or more starts a new sentence."""
    at = [i for i, c in enumerate(masked(line)) if c == ";"]
    if len(at) != 1:
        return line
    before, after = line[: at[0]], line[at[0] + 1 :]
    m = re.match(r"^ ([a-z])(\w*\s+\S+.*)$", after, re.A)
    return f"{before}. {m[1].upper()}{m[2]}" if m and len(before.split()) >= 3 else line


CELL_RULES: list[Rule] = [("bold-label-colon", bold_label_colon), ("paired-dash-parens", paired_dashes), ("range-to", range_to), ("semicolon-sentence", semicolon_sentence)]


def table_cells(line: str) -> str:
    """The cell rules in every cell of a row; refused if pipes or balance would change."""
    if not _ROW.match(line):
        return line
    open_line = masked(line)
    edges = [i for i, c in enumerate(open_line) if c == "|" and line[i] == "|" and (i == 0 or line[i - 1] != "\\")]
    if len(edges) < 2:
        return line

    def cell(text: str) -> str:
        if not dash_offends(text):
            return text
        if re.fullmatch(r"\s*[—–]\s*", text):
            return re.sub("[—–]", "-", text)
        lead, trail = re.match(r"\s*", text)[0], re.search(r"\s*\Z", text)[0]
        body = rewrite(text[len(lead) : len(text) - len(trail)], CELL_RULES, dash_offends, passes=3)[0]
        return f"{lead}{body}{trail}"

    cuts = [-1, *edges, len(line)]
    out = "|".join(cell(line[a + 1 : b]) for a, b in zip(cuts, cuts[1:], strict=False))
    worse = not row_faults(line) and row_faults(out)
    return line if out.count("|") != line.count("|") or _bars(out) != _bars(line) or worse else out


DASH_RULES: list[Rule] = [("heading-colon", heading_colon), ("table-cell", table_cells), *CELL_RULES]


def rewrite(line: str, rules: list[Rule], offends: Callable[[str], bool], passes: int = 4) -> tuple[str, list[str], bool]:
    """(line, rules applied, clean): the first rule that changes the line wins each pass."""
    applied: list[str] = []
    for _ in range(passes):
        if not offends(line):
            break
        step = next(((n, out) for n, rule in rules if (out := rule(line)) != line and (not _ROW.match(line) or (_bars(out) == _bars(line) and (row_faults(line) or not row_faults(out))))), None)
        if step is None:
            break
        applied.append(step[0])
        line = step[1]
    return line, applied, not offends(line)


_STAR = re.compile(r"(?<![*A-Za-z0-9_])\*(?!\s)(?!\*)([^*\n]+?)(?<!\s)\*(?!\*)")
_LOW = re.compile(r"(?<![A-Za-z0-9_\\])_(?!\s)(?!_)([^_\n]+?)(?<!\s)_(?![A-Za-z0-9_])")
_TAG = re.compile(r"</?(?:em|i)(?:\s[^>]*)?>", re.I)


def italics_offend(line: str) -> bool:
    m = masked(line, "x")
    return bool(_STAR.search(m) or _LOW.search(m) or _TAG.search(line))


def drop_italics(line: str) -> str:
    m = masked(line, "x")
    spans = sorted({x.span() for r in (_STAR, _LOW) for x in r.finditer(m)}, reverse=True)
    for a, b in spans:
        line = line[:a] + line[a + 1 : b - 1] + line[b:]
    return line


def drop_html_italics(line: str) -> str:
    return _TAG.sub("", line)


_PICTURE = re.compile("[←-⇿⟰-⟿⤀-⥿⬀-⬑☀-➿■-◿️\U0001f000-\U0001faff]")


def emoji_offends(line: str) -> bool:
    return bool(_PICTURE.search(masked(line)))


def link_label_arrow(line: str) -> str:
    return re.sub(r"(\[[^\]]*?)\s*[←-⇿]\s*(\]\()", r"\1\2", line)


def status_cells(line: str) -> str:
    """A cell that is only a tick or a cross becomes Yes or No."""
    if not _ROW.match(line):
        return line
    for a, b in reversed(cell_spans(line)):
        raw = line[a:b]
        mark = raw.strip().replace("️", "")
        word = "Yes" if mark in ("✅", "✔", "✓") and mark else "No" if mark in ("❌", "✗", "✘") and mark else ""
        if word:
            line = line[:a] + raw.replace(raw.strip(), word) + line[b:]
    return line


def decorative_prefix(line: str) -> str:
    m = re.match(r"^(\s*(?:>\s*)*(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+)?)((?:[☀-⛿✨\U0001f300-\U0001faff]️?\s*)+)(?=\S)", line)
    return line[: len(m[1])] + line[m.end() :] if m else line


def dot_separator(line: str) -> str:
    """A middle dot with space on both sides becomes a comma."""
    for m in reversed(list(re.finditer(r"[ \t]+·[ \t]+", masked(line)))):
        if line[: m.start()].strip() and line[m.end() :].strip():
            line = f"{line[: m.start()]}, {line[m.end() :]}"
    return line


def lead_in_ellipsis(line: str) -> str:
    """An ellipsis that ends a cell or line and stands for no list goes."""
    for m in reversed(list(re.finditer(r"…(?=\s*(?:\||\Z))", masked(line)))):
        start = line.rfind("|", 0, m.start()) + 1
        cell = line[start : m.start()]
        if cell.strip() and cell.count('"') % 2 == 0 and cell.count(",") < 2:
            line = line[:start] + cell.rstrip() + line[m.end() :]
    return line


def marks_offend(line: str) -> bool:
    return bool(re.search("[·§…×≥≤≠•‣⁃±≈∞]", masked(line)))


FAMILIES: dict[str, tuple[list[Rule], Callable[[str], bool], str]] = {
    "dashes": (DASH_RULES, dash_offends, "C3-05"),
    "italics": ([("drop-html-italics", drop_html_italics), ("drop-italics", drop_italics)], italics_offend, "C3-28"),
    "emoji": ([("link-label-arrow", link_label_arrow), ("status-cell-word", status_cells), ("drop-decorative-prefix", decorative_prefix)], emoji_offends, "C3-27"),
    "typography": ([("dot-separator-comma", dot_separator), ("trailing-lead-in-ellipsis", lead_in_ellipsis)], marks_offend, "C3-30"),
}
#: A native test that any offending line meets, so that few lines reach Python.
QUICK = {"dashes": "[—–;]", "italics": "[*_]|<", "emoji": r"[^\x{0}-\x{218F}]", "typography": "[·§…×≥≤≠•‣⁃±≈∞]"}


def rewrites(c: Corpus, family: str) -> DataFrame:
    """doc_id, line_no, rule_id, before, after, applied, clean of every offending line of a family."""
    rules, offends, rule_id = FAMILIES[family]

    @F.pandas_udf("after string, applied string, clean boolean, bad boolean")
    def run(lines: pd.Series) -> pd.DataFrame:
        rows = []
        for s in lines:
            bad = offends(s)
            after, applied, clean = rewrite(s, rules, offends) if bad else (s, [], True)
            rows.append((after, "+".join(applied), clean, bad))
        return pd.DataFrame(rows, columns=["after", "applied", "clean", "bad"])

    some = c.lines.where(F.col("raw").rlike(QUICK[family])).select("doc_id", "line_no", F.col("raw").alias("before"), run("raw").alias("x"))
    return some.where("x.bad").select("doc_id", "line_no", F.lit(rule_id).alias("rule_id"), "before", "x.after", "x.applied", "x.clean")


def acronym_rewrites(c: Corpus, findings: DataFrame) -> DataFrame:
    """The first bare use of each acronym with its expansion put before it, where the line allows it.

    ``findings``: doc_id, line_no of acronym first uses.  Headings, table rows,
    labels and uses inside parentheses or compounds are refused.
    """
    lines = c.lines.join(findings.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"])
    out = F.col("raw")
    for a, full in ACRONYMS:
        # One pattern per acronym: the line holds no expansion, and the first use stands free.
        whole = full[0].upper() + full[1:]
        out = F.regexp_replace(out, rf"^(?!(?i:.*{full}))((?:(?!\b{a}\b)[^(`])*?)(?<![\w/-])\b{a}\b(?![\w/(-]|\s*\()", f"$1{whole} ({a})")
    plain = ~F.col("raw").rlike(r"^\s*(?:#{1,6}\s|\||\*\*)")
    return lines.where(plain).select("doc_id", "line_no", F.lit("C8-07").alias("rule_id"), F.col("raw").alias("before"), out.alias("after")).where("before <> after")


# ---- anchors after headings changed ---------------------------------------------------------------


def slug_map(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, old, new: slugs that went, paired by order with slugs that came, where their counts agree.

    ``before`` and ``after``: path, line_no, text of headings.
    """
    slugs = lambda d: d.select("path", "line_no", slug(F.col("text")).alias("slug")).groupBy("path", "slug").agg(F.min("line_no").alias("line_no"))
    old, new = slugs(before), slugs(after)
    order = Window.partitionBy("path").orderBy("line_no")
    whole = Window.partitionBy("path")
    number = lambda d, name: d.withColumn("k", F.row_number().over(order)).withColumn(f"n_{name}", F.count(F.lit(1)).over(whole)).withColumnRenamed("slug", name).drop("line_no")
    gone = number(old.join(new.select("path", "slug"), ["path", "slug"], "left_anti"), "old")
    came = number(new.join(old.select("path", "slug"), ["path", "slug"], "left_anti"), "new")
    return gone.join(came, ["path", "k"]).where("n_old = n_new").select("path", "old", "new")


def repointed_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """``links(path, to, line_no, target, fragment)`` whose fragment was renamed, with the new target."""
    s = slugs.select(F.col("path").alias("to"), F.col("old").alias("fragment"), "new")
    return links.join(s, ["to", "fragment"]).select("path", "line_no", "target", F.concat(F.regexp_extract("target", "^([^#]*#)", 1), "new").alias("new_target"))


# ---- integrity of edits ----------------------------------------------------------------------------------


def edit_problems(pairs: DataFrame, budget: int = 4) -> DataFrame:
    """doc_id, line_no, problem of every ``pairs(doc_id, before, after)`` that an edit may not cause.

    Line counts, fences, inline code and link targets, emptied lines, quote depth,
    table shape, and at most ``budget`` words changed on a line.
    """
    b, a = F.split("before", "\n"), F.split("after", "\n")
    docs = pairs.where("not before <=> after").select("doc_id", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    moved = docs.where(F.size(b) != F.size(a)).select("doc_id", F.lit(None).cast("int").alias("line_no"), F.lit("line-count").alias("problem"))
    same = docs.where(F.size(b) == F.size(a))

    def bodies(c: str):
        lines = F.split(c, "\n")
        start = F.struct(F.lit(False).alias("open"), F.lit("").alias("text"))
        return F.aggregate(lines, start, lambda acc, s: F.struct(
            F.when(s.rlike(r"^\s*(```|~~~)"), ~acc["open"]).otherwise(acc["open"]).alias("open"),
            F.when(acc["open"] | s.rlike(r"^\s*(```|~~~)"), F.concat(acc["text"], F.lit("\n"), s)).otherwise(acc["text"]).alias("text"),
        ), lambda acc: acc["text"])

    fences = same.where(bodies("before") != bodies("after")).select("doc_id", F.lit(None).cast("int").alias("line_no"), F.lit("fence").alias("problem"))
    parts = [moved, fences]
    for name, pattern, group in (("inline-code", "`[^`\n]+`", 0), ("link-target", r"\]\(([^)\s#]+)", 1)):
        count = lambda c, n, p=pattern, g=group: same.select("doc_id", F.explode(F.regexp_extract_all(c, F.lit(p), g)).alias("item")).groupBy("doc_id", "item").agg(F.count(F.lit(1)).alias(n))
        lost = count("before", "n").join(count("after", "m"), ["doc_id", "item"], "left").where("coalesce(m, 0) < n")
        parts.append(lost.select("doc_id", F.lit(None).cast("int").alias("line_no"), F.lit(name).alias("problem")))
    lines = same.select("doc_id", F.posexplode(F.arrays_zip(b.alias("b"), a.alias("a"))).alias("i", "x")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.col("x.b").alias("b"), F.col("x.a").alias("a")).where("b <> a")
    empty = (F.trim("b") == "") != (F.trim("a") == "")
    depth = lambda c: F.length(F.regexp_replace(F.regexp_extract(c, r"^((?:\s*>)+)", 1), "[^>]", ""))

    @F.pandas_udf("boolean")
    def misshapen(before: pd.Series, after: pd.Series) -> pd.Series:
        bad = lambda x, y: bool((_ROW.match(x) or _ROW.match(y)) and (_bars(x) != _bars(y) or (not row_faults(x) and row_faults(y))))
        return pd.Series([bad(x, y) for x, y in zip(before, after, strict=True)])

    words = lambda c: F.regexp_replace(F.lower(F.regexp_replace(c, "[—–;·§…×≥≤≠•±≈]", " ")), r"[()\[\]{}.,:!?\"'*`]", " ")
    full = lines.where(~empty)
    parts += [
        lines.where(empty).select("doc_id", "line_no", F.lit("emptied").alias("problem")),
        full.where(depth("b") != depth("a")).select("doc_id", "line_no", F.lit("quote-depth").alias("problem")),
        full.where(misshapen("b", "a")).select("doc_id", "line_no", F.lit("table-shape").alias("problem")),
        full.where(over_budget(words("b"), words("a"), F.lit(budget))).select("doc_id", "line_no", F.lit("wording").alias("problem")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
