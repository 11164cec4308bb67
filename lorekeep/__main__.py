"""Command line over a folder: build, audit, query, compare, mark, report, memory.

Exit codes: 0 done; 2 wrong arguments; 3 the store must be rebuilt; 4 nothing was found; 5 the audit found differences;
6 sources are left to merge.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lorekeep.functions.text import project_of_directory
from lorekeep.service import Service
from lorekeep.sources import sinks
from lorekeep.streaming.ingest import BATCH_CHUNKS, AuditFailed

DONE, WRONG, REBUILD, NOTHING, DIFFERS, UNMERGED = 0, 2, 3, 4, 5, 6


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lorekeep")
    parser.add_argument("--folder", required=True, help="where index, events and records are kept")
    commands = parser.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build", help="take in new logs")
    build.add_argument("root")
    build.add_argument("--full", action="store_true", help="everything anew")
    build.add_argument("--audit", action="store_true", help="count differences afterwards")
    build.add_argument("--quiet", action="store_true")
    build.add_argument("--batch-chunks", type=int, default=BATCH_CHUNKS)
    build.add_argument("--max-seconds", type=float)
    for name in ("query", "compare"):
        c = commands.add_parser(name)
        c.add_argument("text")
        c.add_argument("--k", type=int, default=20)
        scope = c.add_mutually_exclusive_group()
        scope.add_argument("--project", help="default: the project of the working directory")
        scope.add_argument("--all-projects", action="store_true")
        c.add_argument("--format", choices=("human", "json", "recall"), default="human")
        c.add_argument("--root", help="logs to take in first")
        c.add_argument("--max-refresh-seconds", type=float)
        if name == "query":
            c.add_argument("--strategy", default="archival")
            c.add_argument("--exclude-session", action="append", default=[])
            c.add_argument("--record", action="store_true")
        else:
            c.add_argument("--strategies", nargs=2, default=["archival", "human-like"])
    mark = commands.add_parser("mark")
    mark.add_argument("presentation")
    mark.add_argument("rank", type=int)
    mark.add_argument("kind")
    commands.add_parser("report")
    memory = commands.add_parser("memory", help="what the usage log holds; --prune writes a clean copy")
    memory.add_argument("--prune", metavar="FOLDER")
    return parser


def _scope(spark: SparkSession, a: argparse.Namespace) -> str | None:
    if a.all_projects:
        return None
    if a.project:
        return a.project
    return spark.range(1).select(project_of_directory(F.lit(os.getcwd()))).first()[0]


def _told(found, form: str) -> str:
    if form == "json":
        return "\n".join(r["line"] for r in sinks.json_lines(found).limit(sinks.MOST_RESULTS).collect())
    return sinks.human(found) if form == "human" else sinks.recall_block(found)


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(args)
    spark = spark or SparkSession.builder.appName("lorekeep").getOrCreate()
    service = Service(spark, a.folder)
    try:
        if a.command == "build":
            report = service.build(a.root, a.full, audit=a.audit, batch_chunks=a.batch_chunks, budget_seconds=a.max_seconds, progress=None if a.quiet else lambda text: print(text, file=sys.stderr))
            print(report)
            if a.audit:
                figures = service.audit().orderBy("figure").collect()
                print("\n".join(f"{r['figure']}: {r['n']}" for r in figures))
                if any(r["n"] for r in figures):
                    return DIFFERS
            return UNMERGED if report.unmerged else DONE
        if a.command in ("query", "compare"):
            if a.command == "query":
                found = service.query(a.text, a.k, _scope(spark, a), a.strategy, a.exclude_session, a.record, a.root, a.max_refresh_seconds)
            else:
                number, found = service.compare(a.text, *a.strategies, k=a.k, project=_scope(spark, a), root=a.root, refresh_seconds=a.max_refresh_seconds)
                print(f"presentation {number}")
            for line in service.notice.lines():
                print(line, file=sys.stderr)
            print(_told(found, a.format))
            return NOTHING if found.isEmpty() else DONE
        if a.command == "mark":
            service.mark(a.presentation, a.rank, a.kind)
        elif a.command == "memory":
            service.memory_status().orderBy("fact").show(1000, truncate=False)
            if a.prune:
                print(f"{service.prune(a.prune)} events kept in {a.prune}")
        else:
            service.report().orderBy("level", "query_class", "strategy").show(1000, truncate=False)
        return DONE
    except AuditFailed as failed:
        print(failed, file=sys.stderr)
        return DIFFERS
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return REBUILD if "rebuild" in str(wrong) else WRONG


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
