"""Documents as (doc_id, path, text): Markdown files, tables, and corpora derived from test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.snippets import SNIPPETS

#: Folders that hold no documents.
SKIPPED = ["node_modules", "images", "img", "assets"]


def markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every .md file below ``folder``; dot files and skipped folders left out.

    The id is the file's place in path order is not needed by any operator, so it
    is a hash of the path: no global sort.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder)
    root = folder.rstrip("/") + "/"
    path = F.regexp_replace(F.input_file_name(), "^.*?" + root.replace(".", r"\.").lstrip("/"), "")
    rows = files.select(path.alias("path"), F.col("value").alias("text"))
    parts = F.split("path", "/")
    hidden = F.exists(parts, lambda s: s.startswith(".") | s.isin(SKIPPED))
    return rows.where(~hidden).select(F.xxhash64("path").alias("doc_id"), "path", "text")


def plain_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", F.concat(F.lit("docs/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


def derived_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text between two pieces of markup chosen by its id.

    The raw texts hold no markup, so structural operators would return nothing.
    """
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = len(SNIPPETS)
    pick = lambda k: F.element_at(F.array(*map(F.lit, SNIPPETS)), (F.pmod(k, F.lit(n)) + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(f) for f in FOLDERS]), (F.pmod("doc_id", F.lit(len(FOLDERS))) + 1).cast("int"))
    return rows.select(
        "doc_id", F.concat(folder, F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
        F.concat(pick(F.col("doc_id")), F.lit("\n\n"), F.col("text"), F.lit("\n\n"), _body(pick(F.col("doc_id") * 7 + 3)), F.lit("\n")).alias("text"),
    )


#: Folders of the derived documents, in several corpus classes.
FOLDERS = ["docs/guide/", "docs/prompts/", "notes/", "docs/"]


def _body(snippet):
    """A snippet without its front matter, as it stands in the middle of a document."""
    return F.regexp_replace(snippet, r"^---\n(?:.*\n)*?---\n", "")


def derived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as Markdown by a fixed chain of replacements: headings, lists and links."""
    text = F.coalesce("html", F.lit(""))
    for pattern, put in PAGE_STEPS:
        text = F.regexp_replace(text, pattern, put.replace("\\1", "$1").replace("\\2", "$2"))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"), text.alias("text"))


PAGE_STEPS = [
    (r"<h1>", "\n# "),
    (r"</h1>", "\n"),
    (r'<li><a href="([^"]*)">([^<]*)</a></li>', "\n- [\\2](\\1)"),
    (r"</p>", "\n"),
    (r"<br>", "\n"),
    (r"<[^>]*>", ""),
]


def derived_sql() -> str:
    """The derived documents in DuckDB's SQL: relation ``derived(doc_id, path, text)``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    n = len(SNIPPETS)
    listed = ",\n".join(quote(s) for s in SNIPPETS)
    folders = ", ".join(quote(f) for f in FOLDERS)
    return f"""snippets AS (SELECT [{listed}] AS s),
derived AS (
  SELECT doc_id, list_extract([{folders}], CAST(doc_id % {len(FOLDERS)} + 1 AS INT)) || 'doc-' || doc_id || '.md' AS path,
    list_extract(s, CAST(doc_id % {n} + 1 AS INT)) || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10)
    || regexp_replace(list_extract(s, CAST((doc_id * 7 + 3) % {n} + 1 AS INT)), '^---\\n(?:.*\\n)*?---\\n', '') || chr(10) AS text
  FROM documents, snippets
)"""


def derived_api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page of an API reference: six make a library of one class.

    Of each six ids one is the usage guide, one the class page and four are methods;
    the text's whole first paragraph to last follows the page's frame.
    """
    from lectern.sources.snippets import CLASS_PAGES, GUIDE_PAGES, METHOD_PAGES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    library, place = F.floor(F.col("doc_id") / 6), F.pmod("doc_id", F.lit(6))
    frame = lambda frames: F.element_at(F.array(*map(F.lit, frames)), (F.pmod(library, F.lit(3)) + 1).cast("int"))
    folder = F.concat(F.lit("api/lib"), library.cast("string"), F.lit("/"))
    path = (
        F.when(place == 0, F.concat(folder, F.lit("usage_guide.md"))).when(place == 1, F.concat(folder, F.lit("k0/class_reference.md")))
        .otherwise(F.concat(folder, F.lit("k0/methods/m"), (place - 1).cast("string"), F.lit(".md")))
    )
    head = F.when(place == 0, frame(GUIDE_PAGES)).when(place == 1, frame(CLASS_PAGES)).otherwise(frame(METHOD_PAGES))
    tail = F.when((place > 1) & (F.pmod(library, F.lit(3)) != 1), F.lit("\n\n---\n")).otherwise(F.lit("\n"))
    return rows.select("doc_id", path.alias("path"), F.concat(head, F.lit("\n"), F.col("text"), tail).alias("text"))
