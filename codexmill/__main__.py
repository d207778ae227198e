"""Command line: convert-html, convert-docx, ingest, inspect, search, evaluate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import load_settings
from .plans import service
from .sources.files import read_cases
from .sources.sinks import Store


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser("codexmill", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in ("convert-html", "convert-docx", "inspect"):
        p = sub.add_parser(name)
        p.add_argument("folder")
        p.add_argument("out")
    p = sub.add_parser("ingest")
    p.add_argument("store")
    p.add_argument("--folder")
    p = sub.add_parser("search")
    p.add_argument("store")
    p.add_argument("query")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--mode", choices=("semantic", "hybrid"))
    p = sub.add_parser("evaluate")
    p.add_argument("store")
    p.add_argument("cases")
    p.add_argument("--out", default="reports")
    p.add_argument("--top-k", type=int, default=20)
    p.add_argument("--mode", choices=("semantic", "hybrid"), default="semantic")
    a = top.parse_args(args)
    settings, spark = load_settings(), SparkSession.builder.getOrCreate()
    show = lambda x: print(json.dumps(x, ensure_ascii=False, default=str))
    if a.command.startswith("convert"):
        rows = service.convert(spark, a.folder, a.out, a.command.removeprefix("convert-")).collect()
        show([r.asDict() for r in rows])
        return int(any(r["status"] == "failed" for r in rows) or not rows)
    if a.command == "inspect":
        show([r.asDict() for r in service.inspect(spark, a.folder, a.out, settings.chunk_size, settings.chunk_overlap).collect()])
        return 0
    store = Store(spark, a.store)
    if a.command == "ingest":
        show(service.ingest(spark, a.folder or settings.docs_dir, store, settings))
        return 0
    table = service.corpus(store.documents(), store.chunks(), service.stop_words(spark))
    if a.command == "search":
        show(service.search_one(spark, table, a.query, a.top_k, a.mode, settings=settings, held=store.postings()))
    else:
        show(service.write_reports(spark, table, read_cases(spark, a.cases), a.out, a.top_k, a.mode, settings, held=store.postings()))
    return 0


if __name__ == "__main__":
    sys.exit(main())
