"""Seven commands over run folders of stage tables: ``python -m pagemill <command> --run-dir DIR ...``.

One line of JSON with the command, its exit code and status goes to stdout; diagnostics go to stderr.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.contract import MAX_ZONE_CHARS, AssemblyError, CaptureError, ContractError, QAFailure
from pagemill.operators import assembly, capture, contracts, qa, report, segments, zones
from pagemill.operators.nodes import dom_nodes
from pagemill.plans.cut import cut
from pagemill.sources import bundle, records

# Exit codes.
OK, ARGUMENTS, CAPTURE, CONTRACT, ASSEMBLY, QA = 0, 2, 3, 4, 5, 6


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="pagemill")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("capture", "extract", "plan-zones", "prepare-assignments", "validate-translations", "assemble", "qa"):
        own = commands.add_parser(name)
        own.add_argument("--run-dir", required=True)
        if name == "capture":
            own.add_argument("--pages", required=True, help="Parquet with page_id, url, html")
            own.add_argument("--bodies", help="Parquet with url, status, location, content_type, content")
            own.add_argument("--captured-at", required=True)
        if name == "plan-zones":
            own.add_argument("--max-chars", type=int, default=MAX_ZONE_CHARS)
            own.add_argument("--target-zones", type=int)
        if name == "prepare-assignments":
            own.add_argument("--glossary", required=True, help="Parquet with page_id, term, gloss")
            own.add_argument("--summaries", required=True, help="Parquet with page_id, summary")
        if name in ("validate-translations", "assemble", "qa"):
            own.add_argument("--translations", required=True, help="Parquet with page_id, zone_id, segment_id, text")
        if name == "validate-translations":
            own.add_argument("--zone-id")
        if name in ("assemble", "qa"):
            own.add_argument("--glossary", required=True)
            own.add_argument("--output-dir", required=True)
        if name == "qa":
            own.add_argument("--review", help="Parquet with page_id, items: what the review leaves unresolved")
            own.add_argument("--findings", help="Parquet with page_id, zone_id, dimension, verdict, evidence: what the review found")
            own.add_argument("--retries", help="Parquet with page_id, zone_id, n; none is 0 for every zone")
    return top


def _refuse(errors: DataFrame, kind: type[ContractError]) -> None:
    """Raises with the first few error rows, if there are any."""
    rows = errors.limit(5).collect()
    if rows:
        raise kind("; ".join(str(r.asDict()) for r in rows))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    def stage(name: str) -> DataFrame:
        return bundle.read_stage(spark, args.run_dir, name)

    def save(df: DataFrame, name: str, again: bool = False) -> None:
        bundle.write_stage(df, args.run_dir, name, again=again)

    if args.command == "capture":
        pages = spark.read.parquet(args.pages).select("page_id", "url", "html")
        nodes = cut(dom_nodes(pages))
        _refuse(pages.select("page_id", capture.url_error("url").alias("error")).where("error is not null"), CaptureError)
        _refuse(capture.unsupported_pages(pages, nodes), CaptureError)
        _refuse(capture.oversized_pages(pages), CaptureError)
        empty = spark.createDataFrame([], "url string, status int, location string, content_type string, content binary")
        bodies = spark.read.parquet(args.bodies) if args.bodies else empty
        found = cut(capture.closure(capture.page_refs(nodes), capture.base_urls(pages, nodes), bodies))
        _refuse(found.where("error is not null and classification = 'critical'").select("page_id", "url", "error"), CaptureError)
        save(found, "assets")
        rewritten = capture.rewrite_pages(pages, found)
        save(pages.select("page_id", "url").join(rewritten, "page_id"), "pages")
        save(capture.capture_record(pages, found, rewritten, args.captured_at), "captures")
    elif args.command == "extract":
        pages = stage("pages")
        nodes = cut(dom_nodes(pages))
        _refuse(segments.contract_errors(pages, nodes), ContractError)
        targets = cut(segments.targets(nodes))
        marked = cut(segments.mark_pages(pages, targets))
        save(segments.segments(targets, marked), "segments")
        save(marked.select("page_id", "html"), "marked")
    elif args.command == "plan-zones":
        rows = stage("segments")
        _refuse(zones.duplicate_ids(rows), ContractError)
        zones.check_parameters(args.max_chars, args.target_zones)
        _refuse(zones.oversized(zones.units(zones.sections(rows)), args.max_chars), ContractError)
        planned = cut(zones.plan(rows, args.max_chars, args.target_zones))
        _refuse(zones.partition_errors(rows, planned), ContractError)
        save(planned, "zones")
    elif args.command == "prepare-assignments":
        summaries = spark.read.parquet(args.summaries)
        _refuse(contracts.summary_errors(summaries), ContractError)
        _refuse(contracts.overlapping_context(stage("zones")), ContractError)
        save(contracts.assignments(stage("zones"), stage("segments"), spark.read.parquet(args.glossary), summaries), "assignments")
    elif args.command == "validate-translations":
        given, planned = spark.read.parquet(args.translations), stage("zones")
        if args.zone_id:
            one = planned.where(F.col("id") == args.zone_id)
            if one.isEmpty():
                raise ContractError(f"unknown zone: {args.zone_id}")
            _refuse(contracts.zone_result_errors(one, given.where(F.col("zone_id") == args.zone_id), stage("segments")), ContractError)
        else:
            _refuse(contracts.merge_errors(stage("segments"), planned, given), ContractError)
    else:
        given, rows, marked = spark.read.parquet(args.translations), stage("segments"), stage("marked")
        _refuse(contracts.merge_errors(rows, stage("zones"), given), ContractError)
        merged = contracts.merged(rows, given)
        built = cut(assembly.assemble_pages(marked, rows, merged, spark.read.parquet(args.glossary), stage("pages")))
        _refuse(built.where("error is not null").select("page_id", "error"), AssemblyError)
        if args.command == "assemble":
            records.write_lines(bundle.write_pages(built, args.output_dir).select(F.to_json(F.struct("path", "bytes")).alias("value")), f"{args.run_dir}/bundle")
        else:
            after = cut(dom_nodes(built.select("page_id", "html")))
            found = (
                qa.coverage(rows.select("page_id", F.col("id").alias("segment_id")), merged)
                .union(qa.token_integrity(marked, built, rows, merged))
                .union(qa.structure(dom_nodes(marked), after))
                .union(qa.anchors(after))
                .union(qa.dependencies(after))
            )
            none = spark.createDataFrame([], "page_id bigint, items array<string>")
            unresolved = spark.read.parquet(args.review).select("page_id", "items") if args.review else none
            zeros = stage("zones").select("page_id", F.col("id").alias("zone_id"), F.lit(0).alias("n"))
            retries = spark.read.parquet(args.retries).select("page_id", "zone_id", "n") if args.retries else zeros
            noted = spark.read.parquet(args.findings) if args.findings else spark.createDataFrame([], "page_id bigint, zone_id string, dimension string, verdict string, evidence string")
            if args.findings:
                _refuse(contracts.review_errors(stage("zones"), noted, retries, unresolved), ContractError)
            gates = cut(qa.gate(built, cut(found.union(qa.review(unresolved))), unresolved))
            save(gates, "gates", again=True)
            translated = merged.select("page_id", "segment_id")
            save(report.manifests(stage("captures"), rows, stage("zones"), translated, retries, gates), "manifests", again=True)
            save(report.reports(stage("captures"), gates, noted, unresolved, retries), "reports", again=True)
            _refuse(gates.where("not passed").select("page_id", "required"), QAFailure)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    command, code = None, OK
    try:
        args = parser().parse_args(argv)
        command = args.command
        run(spark or SparkSession.builder.appName("pagemill").getOrCreate(), args)
    except ValueError as e:
        if not isinstance(e, ContractError):
            code = ARGUMENTS
        else:
            code = CAPTURE if isinstance(e, CaptureError) else ASSEMBLY if isinstance(e, AssemblyError) else QA if isinstance(e, QAFailure) else CONTRACT
        print(e, file=sys.stderr)
    print(json.dumps({"command": command, "exit_code": code, "status": "ok" if code == OK else "error"}))
    return code
