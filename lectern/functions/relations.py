"""Markdown documents as relations.

``Corpus`` takes documents (doc_id, path, text) and gives lines, fences, front
matter, headings, sections, tables, links and list items.  Parsing stays inside
a document's row (array functions), so nothing is shuffled until an operator
compares documents.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import SPACE, spark
from lectern.functions.scalars import cells, slug, strip

HEADING = spark(r"^ {0,3}(#{1,6})\s+(.+?)\s*#*\s*$")
LIST_ITEM = spark(r"^(\s*)([-*+]|\d+[.)])\s+(.*)$")
SEPARATOR = spark(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)+\|?\s*$")
LINK = r"\[([^\]]*)\]\(([^)]+)\)"
FENCE = spark(r"^(\s*)(`{3,}|~{3,})(.*)$")
QUOTE = spark(r"^(\s*>)+\s?")


def settled(df: DataFrame) -> DataFrame:
    """``df`` behind a one-row generator, so its expressions are computed once."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def let(value: Column, then) -> Column:
    return F.transform(F.array(value), then)[0]


def in_ranges(line: Column, ranges: Column, start: str = "start", stop: str = "stop") -> Column:
    return F.exists(ranges, lambda r: (line >= r[start]) & (line <= r[stop]))


class Corpus:
    def __init__(self, docs: DataFrame):
        """``docs``: doc_id, path, text; a null text counts as empty."""
        self.docs = docs.select("doc_id", "path", F.coalesce("text", F.lit("")).alias("text"))
        #: Places of the sieves that have run over the lines of ``parsed`` (its columns marks and any_mark).
        self.sieves: dict[str, int] = {}
        #: Those of them that let much of all text through.
        self.common: frozenset[str] = frozenset()

    @cached_property
    def split(self) -> DataFrame:
        return settled(self.docs.select("doc_id", "path", F.split("text", "\r?\n").alias("lines")))

    @cached_property
    def parsed(self) -> DataFrame:
        """One row per document: lines, fences, front matter, body_start, headings, tables."""
        bare = lambda s: F.regexp_replace(s, QUOTE, "")
        marks = F.filter(
            F.transform("lines", lambda s, i: F.struct((i + 1).alias("line"), F.when(s.contains("```") | s.contains("~~~"), F.substring(F.regexp_extract(bare(s), FENCE, 2), 1, 1)).otherwise("").alias("ch"), F.when(s.contains("```") | s.contains("~~~"), strip(F.regexp_extract(bare(s), FENCE, 3))).otherwise("").alias("lang"))),
            lambda m: m["ch"] != "",
        )
        close = F.array_position(F.transform(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(1))), strip), "---")
        one = self.split.select("*", marks.alias("marks"), F.when((F.col("lines")[0] == "---") & (F.size("lines") > 1) & (close > 0), close.cast("int") + 1).alias("front_end"))
        one = settled(one)
        ranges = "array<struct<start:int,stop:int,lang:string>>"
        state = F.struct(F.lit(0).alias("open"), F.lit("").alias("ch"), F.lit("").alias("lang"), F.array().cast(ranges).alias("done"))

        def step(acc: Column, m: Column) -> Column:
            closing = (acc["open"] > 0) & (m["ch"] == acc["ch"])
            opening = acc["open"] == 0
            return F.struct(
                F.when(opening, m["line"]).when(closing, F.lit(0)).otherwise(acc["open"]).alias("open"),
                F.when(opening, m["ch"]).otherwise(acc["ch"]).alias("ch"),
                F.when(opening, m["lang"]).otherwise(acc["lang"]).alias("lang"),
                F.when(closing, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("start"), m["line"].alias("stop"), acc["lang"].alias("lang"))))).otherwise(acc["done"]).alias("done"),
            )

        size = F.size("lines")
        last = lambda acc: F.when(acc["open"] > 0, F.concat(acc["done"], F.array(F.struct(acc["open"].alias("start"), size.alias("stop"), acc["lang"].alias("lang"))))).otherwise(acc["done"])
        two = settled(one.select("doc_id", "path", "lines", "front_end", F.coalesce(F.col("front_end") + 1, F.lit(1)).alias("body_start"), F.aggregate("marks", state, step, last).alias("fences")))
        found = F.filter(
            F.transform("lines", lambda s, i: F.struct((i + 1).alias("line"), F.when(s.contains("#"), s).otherwise("").alias("raw"))),
            lambda h: h["raw"].rlike(HEADING) & (h["line"] >= F.col("body_start")) & ~in_ranges(h["line"], F.col("fences")),
        )
        heads = F.transform(found, lambda h: F.struct(
            h["line"].alias("line"), F.length(F.regexp_extract(h["raw"], HEADING, 1)).alias("level"), strip(F.regexp_extract(h["raw"], HEADING, 2)).alias("text"),
        ))
        starts = F.filter(
            F.sequence(F.lit(1), size),
            lambda n: F.get("lines", n - 1).contains("|") & F.coalesce(F.get("lines", n).rlike(SEPARATOR), F.lit(False)) & ~in_ranges(n, F.col("fences")) & ~in_ranges(n + 1, F.col("fences")),
        )
        three = settled(two.select("*", F.transform(heads, lambda h: F.struct(h["line"], h["level"], h["text"], slug(h["text"]).alias("slug"))).alias("heads"), starts.alias("starts")))
        ends = F.transform("heads", lambda h, i: F.struct(
            h["line"].alias("line"), h["level"].alias("level"), h["text"].alias("text"),
            (F.coalesce(F.get(F.filter("heads", lambda x: (x["line"] > h["line"]) & (x["level"] <= h["level"])), F.lit(0))["line"] - 1, size)).alias("end_line"),
            let(F.size(F.filter("heads", lambda x: (x["line"] < h["line"]) & (x["slug"] == h["slug"]))), lambda n: F.when(n > 0, F.concat(h["slug"], F.lit("-"), n.cast("string"))).otherwise(h["slug"])).alias("anchor"),
        ))
        stops = lambda n: F.coalesce(
            F.get(F.filter(F.sequence(F.least(n + 2, size + 1), size + 1), lambda k: (k > size) | ~F.coalesce(F.get("lines", k - 1), F.lit("")).contains("|") | (strip(F.coalesce(F.get("lines", k - 1), F.lit(""))) == "") | in_ranges(k, F.col("fences"))), F.lit(0)) - 1, size
        )
        tables = F.aggregate(
            F.transform("starts", lambda n: F.struct(n.alias("start"), stops(n).cast("int").alias("stop"))),
            F.array().cast("array<struct<start:int,stop:int>>"),
            lambda acc, t: F.when(t["start"] > F.coalesce(F.get(acc, F.size(acc) - 1)["stop"], F.lit(0)), F.concat(acc, F.array(t))).otherwise(acc),
        )
        return settled(three.select("doc_id", "path", "lines", "front_end", "body_start", "fences", ends.alias("headings"), F.when(F.size("starts") > 0, tables).otherwise(F.array().cast("array<struct<start:int,stop:int>>")).alias("tables")))

    def _exploded(self, *columns: str) -> DataFrame:
        """A row per line: ``columns`` of ``parsed``, i, raw, and mark and any_mark where sieves have run."""
        if not self.sieves:
            return self.parsed.select(*columns, F.posexplode("lines").alias("i", "raw"))
        rows = self.parsed.select(*columns, "any_mark", F.posexplode(F.arrays_zip("lines", "marks")).alias("i", "x"))
        return rows.select(*columns, "i", F.col("x.lines").alias("raw"), F.col("x.marks").alias("mark"), "any_mark")

    @cached_property
    def marked_line(self) -> DataFrame:
        rows = self._exploded("doc_id", "body_start", "fences")
        n = F.col("i") + 1
        return rows.select("doc_id", n.alias("line_no"), "raw", in_ranges(n, F.col("fences")).alias("in_fence"), (n >= F.col("body_start")).alias("is_body"), *(["mark", "any_mark"] if self.sieves else []))

    @cached_property
    def every_line(self) -> DataFrame:
        """doc_id, line_no, raw, in_fence, is_body of every line."""
        return self.marked_line.select("doc_id", "line_no", "raw", "in_fence", "is_body")

    @cached_property
    def lines(self) -> DataFrame:
        """Body lines outside fences."""
        return self.every_line.where("is_body and not in_fence").select("doc_id", "line_no", "raw")

    @cached_property
    def headings(self) -> DataFrame:
        return self.parsed.select("doc_id", F.inline("headings")).select("doc_id", F.col("line").alias("line_no"), "level", "text", "end_line", "anchor")

    @cached_property
    def fences(self) -> DataFrame:
        body = lambda f: F.array_join(F.slice("lines", f["start"] + 1, F.greatest(f["stop"] - f["start"] - 1, F.lit(0))), "\n")
        return self.parsed.select("doc_id", F.explode(F.transform("fences", lambda f: F.struct(f["start"].alias("start_line"), f["stop"].alias("end_line"), f["lang"].alias("lang"), body(f).alias("body")))).alias("f")).select("doc_id", "f.*")

    @cached_property
    def tables(self) -> DataFrame:
        """doc_id, start_line, end_line, header, rows (arrays of cells)."""
        rows = lambda t: F.transform(F.slice("lines", t["start"] + 2, F.greatest(t["stop"] - t["start"] - 1, F.lit(0))), cells)
        return self.parsed.select("doc_id", F.explode(F.transform("tables", lambda t: F.struct(t["start"].alias("start_line"), t["stop"].alias("end_line"), cells(F.get("lines", t["start"] - 1)).alias("header"), rows(t).alias("rows")))).alias("t")).select("doc_id", "t.*")

    @cached_property
    def front_matter(self) -> DataFrame:
        """doc_id, present, keys (map, last wins), malformed line numbers."""
        pair = spark(r"^([A-Za-z_][\w-]*):\s?(.*)$")
        inner = F.when(F.col("front_end").isNotNull(), F.transform(F.slice("lines", 2, F.greatest(F.col("front_end") - 2, F.lit(0))), lambda s, i: F.struct((i + 2).alias("line"), s.alias("s")))).otherwise(F.array().cast("array<struct<line:int,s:string>>"))
        told = F.filter(inner, lambda x: (strip(x["s"]) != "") & ~x["s"].rlike(LIST_ITEM))
        base = settled(self.parsed.select("doc_id", "front_end", told.alias("told")))
        named = F.filter("told", lambda x: x["s"].rlike(pair))
        keys = F.transform(named, lambda x: F.struct(F.regexp_extract(x["s"], pair, 1).alias("k"), F.regexp_extract(x["s"], pair, 2).alias("v")))
        # A later line with the same key wins.
        final = let(keys, lambda a: F.filter(a, lambda x, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda y: y["k"] == x["k"])))
        return base.select(
            "doc_id", F.col("front_end").isNotNull().alias("present"), F.map_from_entries(final).alias("keys"),
            F.transform(F.filter("told", lambda x: ~x["s"].rlike(pair)), lambda x: x["line"]).alias("malformed"),
        )

    @cached_property
    def outside(self) -> DataFrame:
        """Lines outside fences, front matter included."""
        return self.every_line.where("not in_fence")

    @cached_property
    def sectioned(self) -> DataFrame:
        """Lines outside fences within an H2 section: doc_id, line_no, section, section_line, raw, said (trimmed)."""
        return self.marked_section.select("doc_id", "line_no", "raw", "said", "section", "section_line")

    @cached_property
    def marked_section(self) -> DataFrame:
        rows = self._exploded("doc_id", "headings", "fences")
        n = F.col("i") + 1
        rows = rows.where(~F.exists("fences", lambda f: (n >= f["start"]) & (n <= f["stop"])))
        home = F.get(F.filter("headings", lambda h: (h["level"] == 2) & (h["line"] <= n) & (n <= h["end_line"])), F.lit(0))
        told = rows.select("doc_id", n.alias("line_no"), "raw", strip(F.col("raw")).alias("said"), home["text"].alias("section"), home["line"].alias("section_line"), *(["mark", "any_mark"] if self.sieves else []))
        return told.where("section_line is not null")

    def _passes(self, name: str, mark: str) -> Column:
        return F.col(mark).bitwiseAND(F.lit(1 << self.sieves[name]).cast("long")) != 0

    @cached_property
    def found_line(self) -> DataFrame:
        """Rows of ``marked_line`` that a sieve other than the common ones lets through."""
        rare = sum(1 << k for name, k in self.sieves.items() if name not in self.common)
        return self.marked_line.where(F.col("mark").bitwiseAND(F.lit(rare).cast("long")) != 0)

    def may(self, *names: str, of: str = "lines") -> DataFrame:
        """Rows of ``lines`` (or every_line, outside, sectioned) that every named sieve lets through; all where none has run."""
        rows = getattr(self, of)
        if not self.sieves:
            return rows
        some = self.marked_line if self.common.issuperset(names) else self.found_line
        every = self.marked_section if of == "sectioned" else some.where({"lines": "is_body and not in_fence", "outside": "not in_fence", "every_line": "true"}[of])
        for name in names:
            every = every.where(self._passes(name, "mark"))
        return every.select(rows.columns)

    def only(self, *names: str) -> Corpus:
        """The corpus without documents none of whose lines pass one of the named sieves; all of it where none has run.

        ``docs``, links, items and tables stay whole: what is joined with lines or
        headings is narrowed by them.
        """
        if not self.sieves:
            return self
        less = Corpus(self.docs)
        less.sieves, less.common = self.sieves, self.common
        less.__dict__.update({k: self.__dict__[k] for k in ("links", "items", "tables") if k in self.__dict__})
        for part in ("parsed", "marked_line", "marked_section"):
            rows = getattr(self, part)
            for name in names:
                rows = rows.where(self._passes(name, "any_mark"))
            less.__dict__[part] = rows
        return less

    @cached_property
    def links(self) -> DataFrame:
        """doc_id, line_no, ord, label, url, bare (a list item that is only the link)."""
        rows = self.outside.where(F.col("raw").contains("](")).select(
            "doc_id", "line_no", "raw",
            F.posexplode(F.arrays_zip(F.regexp_extract_all("raw", F.lit(LINK), 0).alias("whole"), F.regexp_extract_all("raw", F.lit(LINK), 1).alias("label"), F.regexp_extract_all("raw", F.lit(LINK), 2).alias("url"))).alias("ord", "x"),
        )
        body = strip(F.regexp_extract("raw", LIST_ITEM, 3))
        bare = F.col("raw").rlike(LIST_ITEM) & ((body == F.col("x.whole")) | (F.regexp_replace(body, r"[.:]\z", "") == F.col("x.whole")))
        return rows.select("doc_id", "line_no", "ord", F.col("x.label").alias("label"), F.col("x.url").alias("url"), bare.alias("bare"))

    @cached_property
    def items(self) -> DataFrame:
        """doc_id, line_no, indent, ordered, text of list items outside fences."""
        return self.outside.where(F.col("raw").rlike(LIST_ITEM)).select(
            "doc_id", "line_no", F.length(F.regexp_extract("raw", LIST_ITEM, 1)).alias("indent"),
            F.regexp_extract("raw", LIST_ITEM, 2).rlike("[0-9]").alias("ordered"), F.regexp_extract("raw", LIST_ITEM, 3).alias("text"),
        )

    def first_section(self, names: list[str]) -> Column:
        """Expression over ``parsed``: the first heading whose text is one of ``names``, any case."""
        low = [n.lower() for n in names]
        return F.get(F.filter("headings", lambda h: F.lower(h["text"]).isin(low)), F.lit(0))

    def sections_named(self, names: list[str]) -> DataFrame:
        """doc_id, line, level, text, end_line of the first section so named in each document."""
        return self.parsed.select("doc_id", self.first_section(names).alias("h")).where("h is not null").select(
            "doc_id", F.col("h.line").alias("line"), F.col("h.level").alias("level"), F.col("h.text").alias("section"), F.col("h.end_line").alias("end_line")
        )


def children(h: Column, all_heads: Column) -> Column:
    """Direct children of a heading: inside its section, exactly one level down."""
    return F.filter(all_heads, lambda s: (s["line"] > h["line"]) & (s["end_line"] <= h["end_line"]) & (s["level"] == h["level"] + 1))


def own_lines(h: Column, all_heads: Column) -> Column:
    """Line numbers of a section that lie in no direct child."""
    return let(children(h, all_heads), lambda kids: F.when(
        h["end_line"] > h["line"],
        F.filter(F.sequence(h["line"] + 1, F.greatest(h["end_line"], h["line"] + 1)), lambda n: ~F.exists(kids, lambda k: (n >= k["line"]) & (n <= k["end_line"]))),
    ).otherwise(F.array().cast("array<int>")))


def text_of(numbers: Column, lines: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: F.get(lines, n - 1)), "\n")
