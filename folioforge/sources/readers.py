"""Readers: tables with a checked schema, index files, manifests, JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The frame, if it has the columns in the types; ValueError names all that are missing or differ."""
    have = dict(frame.dtypes)
    wrong = [f"{c}: {have.get(c, 'missing')}, not {kind}" for c, kind in columns.items() if have.get(c) != kind]
    if wrong:
        raise ValueError("; ".join(wrong))
    return frame


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def parse_index(lines: DataFrame, forms: Sequence[str]) -> DataFrame:
    """form, company, cik, filed, file of an index file's lines (column value): the first word is the form, the last three are cik,
    date and file, what is between is the company. Lines with too few words and other forms drop out, and so do headings."""
    words = F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "")
    rows = lines.select(words.alias("w")).filter((F.size("w") >= 5) & F.element_at("w", 1).isin(list(forms)))
    return rows.select(
        F.element_at("w", 1).alias("form"), F.array_join(F.slice("w", F.lit(2), F.size("w") - 4), " ").alias("company"),
        F.element_at("w", -3).alias("cik"), F.element_at("w", -2).alias("filed"), F.element_at("w", -1).alias("file"),
    )


def read_index(spark: SparkSession, path: str, forms: Sequence[str]) -> DataFrame:
    """An index file's rows; nothing before the rule of dashes can have a wanted form in front and a date before its last word."""
    return parse_index(spark.read.text(path), forms).filter(F.col("filed").rlike("^[0-9]{4}-?[0-9]{2}-?[0-9]{2}$"))


def daily_urls(spark: SparkSession, host: str, start: str, days: int) -> DataFrame:
    """day, url of the `days` days after start."""
    made = spark.range(1, days + 1).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("day"))
    return made.select("day", F.concat(F.lit(host + "/"), F.year("day"), F.lit("/QTR"), F.quarter("day"), F.lit("/form."), F.date_format("day", "yyyyMMdd"), F.lit(".idx")).alias("url"))


def index_links(pages: DataFrame, base: str) -> DataFrame:
    """url of each exhibit that an index page's (column html) document table lists under a type EX-2 or EX-10."""
    row = r"(?is)<tr[^>]*>.*?</tr>"
    rows = pages.select(F.explode(F.regexp_extract_all("html", F.lit(row), F.lit(0))).alias("r"))
    href = F.regexp_extract("r", r'(?is)<a[^>]*href="([^"]+)"', 1)
    kept = rows.filter(F.col("r").rlike(r"(?is)<td[^>]*>\s*EX-(?:2|10)(?:[.][0-9]+)?\s*</td>") & (href != ""))
    return kept.select(F.when(F.startswith(href, F.lit("/")), F.concat(F.lit(base), href)).otherwise(href).alias("url"))


def kind_of(url: Column) -> Column:
    """txt or html by the address."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(F.endswith(path, F.lit(".txt")), "txt").when(path.rlike(r"\.html?$"), "html")


def manifest_states(rows: DataFrame, manifest: DataFrame, key: str, text: str) -> DataFrame:
    """key, state: same, changed, missing (listed, not there) or extra (there, not listed), by the SHA-256 of the text."""
    there = rows.select(key, F.sha2(text, 256).alias("_now"))
    joined = there.join(manifest.select(key, "sha256"), key, "full")
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("_now") == F.col("sha256"), "same").otherwise("changed")
    return joined.select(key, state.alias("state"))


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file of JSON lines; lines that do not parse are kept whole in _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def rendered(pages: DataFrame, key: str, url: str, content: str) -> DataFrame:
    """key, kind, text: pages by the kind of their address; text files as they are, HTML as its shown text, others null."""
    from folioforge.operators.documents import html_text

    typed = pages.select(key, kind_of(F.col(url)).alias("kind"), F.col(content).alias("_c"))
    html = html_text(F.when(F.col("kind") == "html", F.col("_c")))
    return typed.select(key, "kind", F.when(F.col("kind") == "txt", F.col("_c")).when(F.col("kind") == "html", html).alias("text"))


def read_training(spark: SparkSession, path: str, columns: dict[str, str], lead: str, order: Sequence[str]) -> DataFrame:
    """A table with the columns checked, and each row's place in that order, by ranges: no task sorts the whole table. lead: order's first."""
    from folioforge.operators.rollups import running

    rows = require(spark.read.parquet(path).select(*columns), columns)
    return running(rows, lead, [F.col(c) for c in order], {"place": F.lit(1)})


def download_pages(spark: SparkSession, fetch: Callable[[str | None], tuple[list[tuple], str | None]], schema: str, folder: str) -> DataFrame:
    """The rows of a paged source, written page by page with the cursor that comes next, so that a download goes on where it stopped.

    fetch(cursor) gives a page's rows and the next cursor, null at the end; a page is held by the driver, the table is not.
    """
    marks = f"{folder}/cursors"

    def held() -> dict[int, str | None]:
        try:
            return {r.page: r.next for r in spark.read.schema("page int, next string").json(marks).collect()}
        except Exception as error:  # nothing yet
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return {}

    done = held()
    page = max(done, default=-1)
    cursor = done.get(page)
    while page < 0 or cursor is not None:
        rows, cursor = fetch(cursor)
        page += 1
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/rows/page={page}")
        spark.createDataFrame([(page, cursor)], "page int, next string").coalesce(1).write.mode("append").json(marks)
    return spark.read.parquet(f"{folder}/rows").drop("page")
