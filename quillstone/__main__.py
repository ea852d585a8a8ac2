"""python -m quillstone verify|check|compare|research|recall: the tools over Parquet tables."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import tools
from .operators import reports
from .sources.store import Store, default_path


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillstone", description=__doc__)
    sub = p.add_subparsers(dest="tool", required=True)
    for name, what in (("verify", "a text"), ("research", "a question"), ("recall", "a query")):
        s = sub.add_parser(name)
        s.add_argument("words", nargs="+", help=what)
        s.add_argument("--store", help="folder of the store of evidence")
        if name != "recall":
            s.add_argument("--docs", required=True, help="Parquet table (doc_id, text, ...)")
    sub.choices["research"].add_argument("--mode", default="standard")
    sub.choices["recall"].add_argument("--stale", action="store_true")
    sub.add_parser("check").add_argument("pages", help="Parquet table (url, html)")
    sub.add_parser("compare").add_argument("docs", help="Parquet table (id, text, ...)")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("quillstone").getOrCreate()
    now = int(time.time() * 1000)
    if a.tool == "check":
        tools.check_source(spark.read.parquet(a.pages), now).show(100, False)
        return 0
    if a.tool == "compare":
        total, traced = tools.compare_sources(spark.read.parquet(a.docs))
        total.show(1, False)
        traced.show(100, False)
        return 0
    graph = tools.Graph(spark, Store(spark, a.store or default_path("file://" + __import__("os").path.expanduser("~"))))
    words = " ".join(a.words)
    if a.tool == "recall":
        tools.research_recall(words, graph, now, a.stale).show(100, False)
        return 0
    docs = spark.read.parquet(a.docs)
    if a.tool == "verify":
        out = tools.verify_text(words, docs, graph=graph, now=now)
        for r in reports.claim_report(out.claims, out.citations).orderBy("claim_id").toLocalIterator():
            print(r["report"])
        return int(out.claims.filter(F.col("verdict") == "CONTRADICTED").limit(1).count())
    print(reports.research_report(tools.deep_research(words, docs, mode=a.mode, graph=graph, now=now)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
