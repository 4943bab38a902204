"""Command line: ``build`` an index (and a bundle) from a corpus, ``search`` an index, ``export-model`` to the portable form."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseek.functions import vectors as fv
from loomseek.options import ChunkOptions, HybridOptions, SearchOptions
from loomseek.plans import index as ix
from loomseek.sources import bundle, corpus


def load_model(spark: SparkSession, folder: str) -> DataFrame:
    """token_id, term, v (floats) of a portable model or of a folder with safetensors."""
    if os.path.exists(os.path.join(folder, "model.json")):
        return bundle.read_model(spark, folder).select("token_id", F.col("token").alias("term"), fv.dequantize(F.col("v"), F.col("scale")).alias("v"))
    return bundle.safetensors_model(spark, folder).withColumnRenamed("token", "term")


def build(spark: SparkSession, path: str, model_folder: str, out: str, options: ChunkOptions, bundle_folder: str | None = None, quarantine: bool = False) -> None:
    documents, model = corpus.read_corpus(spark, path), load_model(spark, model_folder)
    index = ix.build(documents, model, options).save(out)
    if bundle_folder is not None:
        vectors = index.table.withColumn("v", fv.unit(F.col("v")))
        bundle.write_bundle(bundle_folder, vectors, model.withColumnRenamed("term", "token"), model_id=os.path.basename(model_folder.rstrip("/")) or "model",
                            chunk_size=options.chunk_size, chunk_overlap=options.chunk_overlap, title_prefix=options.title_prefix, quarantine=quarantine)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="loomseek")
    sub = parser.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    for name in ("corpus", "model", "out"):
        b.add_argument(name)
    b.add_argument("--bundle")
    b.add_argument("--chunk-size", type=int, default=600)
    b.add_argument("--chunk-overlap", type=int, default=120)
    b.add_argument("--no-title-prefix", action="store_true")
    b.add_argument("--quarantine", action="store_true", help="leave out chunks without a known word")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--mode", choices=("semantic", "keyword", "hybrid"), default="semantic")
    s.add_argument("--limit", type=int, default=10)
    e = sub.add_parser("export-model")
    for name in ("model", "out"):
        e.add_argument(name)
    e.add_argument("--dims", type=int)
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName("loomseek").getOrCreate()
    if a.command == "build":
        build(spark, a.corpus, a.model, a.out, ChunkOptions(a.chunk_size, a.chunk_overlap, not a.no_title_prefix), a.bundle, a.quarantine)
    elif a.command == "search":
        options = HybridOptions(limit=a.limit) if a.mode == "hybrid" else SearchOptions(limit=a.limit)
        found = ix.search(ix.Index.load(spark, a.index), spark.createDataFrame([(1, a.query)], "query_id long, query string"), a.mode, options)
        for row in ix.format_results(found.withColumn("query", F.lit(a.query))).collect():
            print(row.text)
    else:
        bundle.write_model(a.out, load_model(spark, a.model).withColumnRenamed("term", "token"), os.path.basename(a.model.rstrip("/")) or "model", a.dims)


if __name__ == "__main__":
    main()
