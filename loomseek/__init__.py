"""Document search and ranking on Spark: chunking, lexical, semantic and hybrid ranking of sets of queries."""

from loomseek.client import SearchClient
from loomseek.options import ChunkOptions, HybridOptions, SearchOptions, SiteOptions, ToolArguments
from loomseek.plans.index import Index, build, search
from loomseek.sources.bundle import Bundle, fetch_bundle, from_bytes, read_bundle, write_bundle
from loomseek.sources.corpus import read_corpus

__all__ = ["Bundle", "ChunkOptions", "HybridOptions", "Index", "SearchClient", "SearchOptions", "SiteOptions", "ToolArguments", "build", "fetch_bundle", "from_bytes", "read_bundle", "read_corpus", "search", "write_bundle"]
