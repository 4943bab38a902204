"""A client of one index, with a method for each mode; and the guarded form in which tools call it."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomseek.options import HybridOptions, SearchOptions, ToolArguments
from loomseek.plans import index as ix
from loomseek.sources import bundle


class Backend(Protocol):
    """Anything that answers one query in three ways."""

    def semantic_search(self, query: str, options: SearchOptions | None = None) -> list[Row]: ...

    def keyword_search(self, query: str, limit: int = 10) -> list[Row]: ...

    def hybrid_search(self, query: str, options: HybridOptions | None = None) -> list[Row]: ...


class SearchClient:
    """Searches an index for single queries; for sets of queries there is :func:`loomseek.plans.index.search`."""

    def __init__(self, index: ix.Index) -> None:
        self.index = index

    @classmethod
    def open(cls, spark: SparkSession, *, path: str | None = None, folder: str | None = None, own: bundle.Bundle | None = None) -> SearchClient:
        """From just one of: the ``path`` of a native index, the ``folder`` of a bundle (or its manifest's ``.json``), or a bundle that was read."""
        if sum(x is not None for x in (path, folder, own)) != 1:
            raise ValueError("give just one of path, folder and own")
        if path is not None:
            return cls(ix.Index.load(spark, path))
        return cls(ix.from_bundle(spark, own if own is not None else bundle.read_bundle(folder)))

    def _ask(self, query: str, mode: str, options: SearchOptions | None) -> list[Row]:
        spark = self.index.table.sparkSession
        asked = spark.createDataFrame([(1, query)], "query_id long, query string")
        return ix.search(self.index, asked, mode, options).orderBy("rank").drop("query_id").collect()

    def semantic_search(self, query: str, options: SearchOptions | None = None) -> list[Row]:
        return self._ask(query, "semantic", options)

    def keyword_search(self, query: str, limit: int = 10) -> list[Row]:
        return self._ask(query, "keyword", SearchOptions(limit))

    def hybrid_search(self, query: str, options: HybridOptions | None = None) -> list[Row]:
        return self._ask(query, "hybrid", options)

    semantic, lexical, hybrid = semantic_search, keyword_search, hybrid_search


def call_tool(client: Backend, arguments: dict, mode: str = "semantic") -> list[Row]:
    """What a tool's arguments ({"query", "limit"}: trimmed, not empty, 5 if not given, 1 to 20) find by one mode."""
    if not isinstance(arguments, dict) or not set(arguments) <= {"query", "limit"} or "query" not in arguments:
        raise ValueError("a tool takes a query and a limit")
    asked = ToolArguments(**arguments)
    if mode == "keyword":
        return client.keyword_search(asked.query, asked.limit)
    if mode == "hybrid":
        return client.hybrid_search(asked.query, HybridOptions(asked.limit))
    if mode != "semantic":
        raise ValueError("mode must be semantic, keyword or hybrid")
    return client.semantic_search(asked.query, SearchOptions(asked.limit))


def copy_sources(pages: DataFrame, folder: str, path: str = "path", text: str = "text") -> None:
    """The source texts of indexed pages as a Parquet table (path, text) in ``folder``, from which single ones can be looked up."""
    pages.select(F.col(path).alias("path"), F.col(text).alias("text")).write.mode("overwrite").parquet(folder)


def source_text(spark: SparkSession, folder: str, path: str) -> str | None:
    """One text that copy_sources wrote; None if there is none under that path."""
    found = spark.read.parquet(folder).where(F.col("path") == path.strip()).head()
    return None if found is None else found.text
