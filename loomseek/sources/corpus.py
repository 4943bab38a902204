"""Corpora: JSON and JSON Lines of documents, rendered pages, and Markdown files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomseek.functions.html import html_sections
from loomseek.functions.paths import kept

_SECTION = T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType()), T.StructField("anchor", T.StringType())])
DOCUMENT = T.StructType([*(T.StructField(n, T.StringType()) for n in ("id", "title", "href", "text")), T.StructField("sections", T.ArrayType(_SECTION))])
#: What the types of a document and of a section must be; a variant's keys are in alphabetical order.
_DOCUMENT = r"OBJECT<href: STRING, id: STRING, (sections: (VOID|ARRAY<.*>), )?text: STRING, title: STRING>"
_PART = r"OBJECT<(anchor: STRING, )?(heading: STRING, )?text: STRING>"


def read_corpus(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Documents of ``.jsonl``/``.ndjson`` (one object a line) or ``.json`` (an array or one object), with doc_ord in file order.

    ValueError if an object lacks a key, has another one, or a value of the wrong type. With ``strict`` lines are in
    ``.jsonl`` alone, and any other file must be an array.
    """
    lines = path.lower().endswith((".jsonl",) if strict else (".jsonl", ".ndjson"))
    if lines:
        raw = spark.read.text(path).where("trim(value) <> ''").select("value", F.monotonically_increasing_id().alias("doc_ord"))
    else:
        whole = spark.read.text(path, wholetext=True)
        is_list = F.ltrim(F.regexp_replace("value", r"^\s+", "")).startswith("[")
        if strict and not whole.where(~is_list).isEmpty():
            raise ValueError("the corpus must be an array of documents")
        as_list = F.when(is_list, F.col("value")).otherwise(F.concat(F.lit("["), "value", F.lit("]")))
        raw = whole.select(F.posexplode_outer(F.from_json(as_list, "array<string>")).alias("doc_ord", "value")).withColumn("doc_ord", F.col("doc_ord").cast("long"))
    typed = raw.withColumn("j", F.try_parse_json("value"))
    sections = F.try_variant_get("j", "$.sections", "array<variant>")
    parts = F.forall(sections, lambda x: F.schema_of_variant(x).rlike(f"^{_PART}$"))
    good = F.schema_of_variant("j").rlike(f"^{_DOCUMENT}$") & F.coalesce(parts, sections.isNull())
    first = typed.where(~F.coalesce(good, F.lit(False))).select("value").head(1)
    if first:
        raise ValueError(f"not a document: {(first[0].value or 'no JSON')[:200]}")
    return raw.select("doc_ord", F.from_json("value", DOCUMENT).alias("d")).select("doc_ord", "d.*")


def page_documents(pages: DataFrame, path: str = "url", html: str = "html", include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Rendered pages whose path is kept, as documents (id and title are the path); pages without text are left out."""
    parsed = pages.where(kept(F.col(path), include, exclude)).select(F.col(path).alias("id"), F.col(path).alias("title"), F.col(path).alias("href"), html_sections(F.col(html)).alias("page"))
    return parsed.select("id", "title", "href", F.col("page.text").alias("text"), F.col("page.sections").alias("sections")).where("text <> ''")


def read_markdown(spark: SparkSession, root: str, path: str) -> str:
    """The text of one Markdown file below ``root``; ValueError for a path that is not relative, leaves it, or is no Markdown."""
    tidy = path.strip()
    if not tidy.endswith(".md") or tidy.startswith("/") or "\\" in tidy or ":" in tidy or any(p in ("", ".", "..") for p in tidy.split("/")):
        raise ValueError("path must be a relative path of a Markdown file")
    return spark.read.text(f"{root.rstrip('/')}/{tidy}", wholetext=True).head().value
