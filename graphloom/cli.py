"""Command line: ``python -m graphloom.cli <command> ...``."""

from __future__ import annotations

import argparse
import sys

from graphloom.session import session


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="graphloom")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("query", help="run a registered query over a folder of tables")
    c.add_argument("name")
    c.add_argument("folder")
    c.add_argument("--output", help="Parquet folder; prints the first rows without it")
    c = commands.add_parser("list", help="names of the registered queries")
    c = commands.add_parser("chunk", help="Markdown files into chunk lines of two granularities")
    c.add_argument("path")
    c.add_argument("output")
    c = commands.add_parser("image-ids", help="image references of Markdown files into metadata blocks with stable ids")
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--paper-id")
    c = commands.add_parser("ingest", help="graph JSONL files into graph tables")
    c.add_argument("path")
    c.add_argument("output")
    c = commands.add_parser("validate", help="structural report of graph JSONL files")
    c.add_argument("path")
    c.add_argument("--output-dir")
    c = commands.add_parser("evaluate", help="evaluation JSON into its four sheets")
    c.add_argument("json")
    c.add_argument("output")
    c = commands.add_parser("pdf", help="Markdown of PDF files by a converter module:function")
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--converter", required=True)
    c = commands.add_parser("extract", help="chunk lines into graph documents by an extraction provider module:function")
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--provider", default="graphloom.models.stub:graph")
    c = commands.add_parser("vectors", help="chunk lines into a vector table by an embedding provider module:function")
    c.add_argument("path")
    c.add_argument("output")
    c.add_argument("--provider", default="graphloom.models.stub:embedding")
    c = commands.add_parser("answer", help="a question answered from graph lines and a vector table")
    c.add_argument("graph")
    c.add_argument("vectors")
    c.add_argument("question")
    c = commands.add_parser("rag", help="a question answered from the single best chunk")
    c.add_argument("vectors")
    c.add_argument("question")
    c.add_argument("--k", type=int, default=1)
    c = commands.add_parser("test-cases", help="test cases of a questions CSV")
    c.add_argument("questions")
    c.add_argument("vectors")
    c.add_argument("output")
    c = commands.add_parser("judge", help="test cases judged by the eight judges")
    c.add_argument("cases")
    c.add_argument("output")
    c.add_argument("--at", default="", help="time to write into the evaluation")
    return parser


def _provider(name: str):
    """The function that ``module:function`` names."""
    from importlib import import_module

    module, function = name.split(":")
    return getattr(import_module(module), function)


def main(argv: list[str] | None = None) -> int:
    """Entry point; 0 on success."""
    args = _parser().parse_args(argv)
    from graphloom.plans import REGISTRY

    if args.command == "list":
        print("\n".join(sorted(REGISTRY)))
        return 0
    spark = session()
    from pyspark.sql import functions as F

    from graphloom import pipeline, sinks, sources
    from graphloom.models import judges
    from graphloom.operators import chunking, evaluation, extraction, graph_build, images

    if args.command == "query":
        if args.name not in REGISTRY:
            print(f"no query {args.name}", file=sys.stderr)
            return 2
        df = REGISTRY[args.name](spark, args.folder)
        df.write.mode("overwrite").parquet(args.output) if args.output else df.show(20, False)
    elif args.command == "chunk":
        docs = sources.markdown_files(spark, args.path).withColumn("doc_id", F.xxhash64("path"))
        sinks.write_chunks(chunking.token_chunks(docs, "doc_id", "text", "stem"), args.output)
    elif args.command == "image-ids":
        docs = sources.markdown_files(spark, args.path)
        done = images.assign_ids(docs, "path", "text", F.col("stem"), F.lit(args.paper_id) if args.paper_id else None)
        sinks.write_markdown(done.join(docs.select("path", "stem"), "path"), args.output, "_with_image_ids")
    elif args.command in ("ingest", "validate"):
        documents = sources.graph_lines(spark, args.path)
        tables = pipeline.ingest(documents)
        if args.command == "ingest":
            sinks.write_graph_tables(tables.nodes, tables.edges, tables.mentions, args.output)
        else:
            raw_nodes, raw_edges, _ = graph_build.explode_documents(documents)
            report = pipeline.validate(tables, raw_nodes, raw_edges)
            sinks.write_report(report, args.output_dir) if args.output_dir else report.show(1, False, True)
    elif args.command == "pdf":
        made = sources.to_markdown(sources.pdf_files(spark, args.path), _provider(args.converter)).where("ok")
        stem = F.regexp_extract("path", r"([^/]+)\.pdf$", 1)
        sinks.write_markdown(made.select(stem.alias("stem"), F.col("markdown").alias("text")), args.output)
    elif args.command == "extract":
        sinks.write_graph_documents(extraction.chunk_documents(sources.chunk_lines(spark, args.path), _provider(args.provider)).drop("doc"), args.output)
    elif args.command == "vectors":
        rows = sources.chunk_lines(spark, args.path).where("length(content) > 0")
        sinks.write_vectors(rows.select(F.xxhash64("id").alias("vec_id"), "id", "content", _provider(args.provider)(F.col("content")).alias("embedding")), args.output)
    elif args.command == "answer":
        tables = pipeline.ingest(sources.graph_lines(spark, args.graph))
        sinks.show(pipeline.hybrid_answer(tables, spark.read.parquet(args.vectors), args.question))
    elif args.command == "rag":
        asked = spark.createDataFrame([(1, args.question)], "question_id bigint, question string")
        sinks.show(pipeline.simple_answer(spark.read.parquet(args.vectors), asked))
    elif args.command == "test-cases":
        asked = sources.questions(spark, args.questions).select(F.monotonically_increasing_id().alias("question_id"), F.col("Question").alias("question"), F.col("Category").alias("category"))
        sinks.write_cases(pipeline.test_cases(spark.read.parquet(args.vectors), asked), args.output, hybrid=False)
    elif args.command == "judge":
        cases = evaluation.usable_cases(sources.test_cases(spark, args.cases, hybrid=False))
        rows = judges.judge(cases.select(F.xxhash64("query", "final_answer").alias("test_idx"), "category", "query", F.array_join("context_parts", "\n").alias("context"), "final_answer"))
        sinks.write_evaluation(rows, args.output, args.at)
    elif args.command == "evaluate":
        rows = evaluation.long(sources.evaluation_json(spark, args.json))
        names = [r.metric for r in rows.select("metric").distinct().orderBy("metric").collect()]
        sinks.evaluation_sheets(rows, names, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
