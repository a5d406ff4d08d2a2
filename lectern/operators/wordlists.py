"""Word-list scans: one row for each line and entry that occurs in it.

Entries are known when the query is planned, so each is an expression with a
constant pattern: no join, one compiled pattern per entry and task.  The literal
part of an entry is looked for first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.patterns import needles, spark, whole_word
from lectern.functions.relations import Corpus, settled
from lectern.functions.scalars import prose, without_code
from lectern.operators.findings import finding
from lectern.operators.wordlist_data import WORDLISTS

def pattern_of(entry: tuple[str, str, str | None, str | None]) -> str:
    return entry[3] or whole_word(entry[2] or "")


def _may_hold(pattern: str) -> Column:
    """A cheap test on ``low``, the text in lower case, that every line with a match passes."""
    some = needles(pattern)
    return reduce(Column.__or__, [F.col("low").contains(n) for n in dict.fromkeys(some)]) if some else F.lit(True)


def scan(lines: DataFrame, text: Column, entries: list[tuple[str, str, str | None, str | None]]) -> DataFrame:
    """doc_id, line_no, raw, said, entry (its place), rule_id, category, hit: first match of each entry in a line.

    One pass: lines that hold no entry's literal part go first, then each entry's
    pattern runs where its own literal part occurs.
    """
    rows = settled(lines.select("doc_id", "line_no", "raw", text.alias("said"))).withColumn("low", F.lower("said"))
    rows = settled(rows)
    tests = [_may_hold(pattern_of(e)) for e in entries]
    hits = F.array(*[
        F.when(test, F.struct(F.lit(k).alias("entry"), F.lit(e[0]).alias("rule_id"), F.lit(e[1]).alias("category"), F.regexp_extract("said", spark(f"({pattern_of(e)})", ignore_case=True), 1).alias("hit")))
        for k, (e, test) in enumerate(zip(entries, tests, strict=True))
    ])
    held = rows.where(reduce(Column.__or__, tests)).select("doc_id", "line_no", "raw", "said", F.explode(F.filter(hits, lambda h: h["hit"] != "")).alias("h"))
    return held.select("doc_id", "line_no", "raw", "said", "h.*")


def banned_phrases(c: Corpus) -> DataFrame:
    hits = scan(c.may("banned-phrases"), without_code(F.col("raw")), WORDLISTS["banned-phrases"])
    return finding(hits, "banned-phrases", 1, F.col("rule_id"))


def metaphors(c: Corpus) -> DataFrame:
    return finding(scan(c.may("metaphors"), without_code(F.col("raw")), WORDLISTS["metaphors"]), "metaphor-phrases", 2, F.col("rule_id"))


def periphrasis(c: Corpus) -> DataFrame:
    return finding(scan(c.may("periphrasis"), without_code(F.col("raw")), WORDLISTS["periphrasis"]), "periphrasis-phrases", 2, F.col("rule_id"))


def passive_voice(c: Corpus) -> DataFrame:
    """Hits that are not wholly in title case."""
    hits = scan(c.may("passive-voice"), without_code(F.col("raw")), WORDLISTS["passive-voice"])
    words = F.regexp_extract_all("hit", F.lit("[A-Za-z]+"), 0)
    title = (F.size(words) > 1) & F.forall(words, lambda w: w.rlike("^[A-Z]"))
    return finding(hits.where(~title), "passive-voice", 2, F.col("rule_id"))


def over_promise_hits(c: Corpus) -> DataFrame:
    """The first entry that hits each line."""
    hits = scan(c.may("over-promise"), prose(F.col("raw")), WORDLISTS["over-promise"])
    return hits.groupBy("doc_id", "line_no").agg(F.min_by("rule_id", "entry").alias("rule_id"), F.min("entry").alias("entry"))


def over_promise(c: Corpus) -> DataFrame:
    return finding(over_promise_hits(c), "over-promise", 2, "C8-10")


#: Wording that exempts a verb from being read as human.
PROTOCOL = r"\b(OAuth|PKCE|handshake|token endpoint|scopes?|authoriz(e|es|ed|ation) (code|server|endpoint)|refresh token|Dynamic Client Registration)\b"
#: What may stand before a line's first word.
OPENER = r"^(?:[>\s]*)(?:#{1,6}\s+|\d+[.)]\s+|[-*+]\s+)?(?:\*\*[^*]+\*\*:?\s*)?(?:[*_]{1,2})?"
#: Subjects that are people.
PEOPLE = (
    r"\b(?:you|your|yours|we|our|us|they|their|them|i|me|my|users?|readers?|authors?|editors?|marketers?|marketing|engineers?|engineering|developers?|designers?|"
    r"teams?|attendees?|sales|customers?|clients?|people|someone|somebody|anyone|anybody|everyone|reviewers?|maintainers?|admins?|administrators?|operators?|"
    r"consultants?|stakeholders?|colleagues?|partners?|managers?|owners?)\b"
)
#: Where a clause ends.
CLAUSE_END = r"[.!?;:,()\[\]|]|\b(?:and|or|but|so|then|because|while|whereas|although|though|unless|until)\b"
#: Auxiliaries, which are no subject.
NO_SUBJECT = (
    r"^(?:\s|\b(?:to|also|often|still|already|now|then|just|only|really|simply|always|never|sometimes|usually|likely|probably|may|might|can|could|will|would|shall|"
    r"should|must|do|does|did|not|no|never|even|rather|instead|therefore|thus|and|or|but|then|so)\b|[*_`\"'(),-])*$"
)


def anthropomorphism(c: Corpus) -> DataFrame:
    """Human verbs with a subject that is no person.

    The subject is sought in the last clause before the hit that holds more than
    auxiliaries; the clauses are what lies between boundaries, read from the end.
    """
    hits = scan(c.may("anthropomorphism"), prose(F.col("raw")), WORDLISTS["anthropomorphism"]).where(~F.col("raw").rlike(spark(PROTOCOL, ignore_case=True)))
    # Text before the hit: the hit's place is that of its first occurrence as this entry matches it.
    at = F.lit(0)
    for k, e in enumerate(WORDLISTS["anthropomorphism"]):
        at = F.when(F.col("entry") == k, F.regexp_instr("said", F.lit(spark(pattern_of(e), ignore_case=True)))).otherwise(at)
    placed = hits.withColumn("before", F.substring("said", F.lit(1), at - 1)).withColumn("opening", F.regexp_extract("said", spark(f"({OPENER})"), 1))
    rest = F.substring("before", F.char_length("opening") + 1, F.char_length("before"))
    imperative = (F.char_length("before") == F.char_length("opening")) | ((F.char_length("before") > F.char_length("opening")) & rest.rlike(spark(r"(^|[.!?:]\s+)(?:\*\*|[*_])?$")))
    clauses = F.split("before", spark(CLAUSE_END, ignore_case=True))
    # The piece before the first boundary is no window of its own: without a subject the whole text counts.
    windows = F.filter(F.slice(clauses, 2, F.greatest(F.size(clauses) - 1, F.lit(1))), lambda w: ~w.rlike(spark(NO_SUBJECT, ignore_case=True)))
    # A window runs from its boundary to the hit, so it includes the pieces after it.
    subject = F.when(F.size(windows) > 0, F.element_at(windows, -1)).otherwise(F.col("before"))
    return finding(placed.where(~imperative & ~subject.rlike(spark(PEOPLE, ignore_case=True))), "anthropomorphism", 1, F.col("rule_id"))


def vague_reference(c: Corpus) -> DataFrame:
    """A forward demonstrative on a line that leads into a fence, table or list, or ends in a colon."""
    hits = scan(c.may("vague-reference"), prose(F.col("raw")), WORDLISTS["vague-reference"]).groupBy("doc_id", "line_no").agg(F.first("raw").alias("raw"))
    plain = ~F.col("raw").rlike(spark(r"^\s*#{1,6}\s")) & ~F.col("raw").rlike(spark(r"^\s*\|"))
    nexts = next_content(c.only("vague-reference"))
    joined = hits.where(plain).join(nexts, ["doc_id", "line_no"], "left")
    opens = F.col("next_in_fence") | F.col("next_raw").rlike(spark(r"^\s*\|")) | F.col("next_raw").rlike(spark(r"^\s*(?:[-*+]\s|\d+[.)]\s)"))
    forward = F.col("raw").rlike(spark(r":\s*$")) | F.coalesce(opens, F.lit(False))
    return finding(joined.where(forward), "vague-reference", 2, "C3-24")


def next_content(c: Corpus) -> DataFrame:
    """doc_id, line_no, next_raw, next_in_fence: the next line with content after each line."""
    from pyspark.sql import Window

    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    some = F.when(F.col("raw").rlike(spark(r"\S")), F.struct("raw", "in_fence"))
    return c.every_line.select("doc_id", "line_no", F.first(some, ignorenulls=True).over(ahead).alias("n")).select(
        "doc_id", "line_no", F.col("n.raw").alias("next_raw"), F.col("n.in_fence").alias("next_in_fence")
    )
