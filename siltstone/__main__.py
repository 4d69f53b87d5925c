"""python -m siltstone: query, ingest, ingest-iceberg, ingest-delta, ingest-corpus, explain, summary, history, serve."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from siltstone.errors import EngineError
from siltstone.nl import ChatService
from siltstone.server import Api, serve
from siltstone.session import Session, query_file


def _shown(table) -> str:  # noqa: ANN001
    return table.to_pandas().to_string(index=False) if table.num_rows else "(no rows)"


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siltstone", description=__doc__)
    p.add_argument("--root", default="siltstone-data", help="folder of the catalog, corpora and history")
    p.add_argument("--workspace", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run SQL over a dataset or a file")
    where = q.add_mutually_exclusive_group(required=True)
    where.add_argument("--file")
    where.add_argument("--dataset")
    q.add_argument("sql")
    for name, what in (("ingest", "CSV file"), ("ingest-iceberg", "metadata JSON file"), ("ingest-delta", "table folder"), ("ingest-corpus", "folder of .txt files")):
        s = sub.add_parser(name)
        s.add_argument("name")
        s.add_argument("path", help=what)
    s = sub.add_parser("explain")
    s.add_argument("dataset")
    s.add_argument("sql")
    sub.add_parser("summary").add_argument("dataset")
    sub.add_parser("history")
    s = sub.add_parser("serve", help="answer over HTTP; the environment variable SILTSTONE_SECRET signs the tokens")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8080)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("siltstone").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        if a.command == "query" and a.file:
            print(_shown(query_file(spark, a.file, a.sql)))
            return 0
        if a.command == "serve":
            api = Api(spark, a.root, os.environ.get("SILTSTONE_SECRET", "").encode(), ChatService.from_environment() if "SILTSTONE_MODEL_URL" in os.environ else None)
            serve(api, a.host, a.port).serve_forever()
            return 0
        session = Session(spark, a.root, a.workspace)
        if a.command == "query":
            print(_shown(session.query(a.dataset, a.sql).table))
        elif a.command == "ingest-corpus":
            print(f"{session.ingest_corpus(a.name, a.path)} chunks")
        elif a.command.startswith("ingest"):
            do = {"ingest": session.ingest_csv, "ingest-iceberg": session.register_iceberg, "ingest-delta": session.register_delta}[a.command]
            s = do(a.name, a.path)
            print(f"snapshot {s.id}: {s.summary['files']} files, {s.summary['rows']} rows")
        elif a.command == "explain":
            print(json.dumps(asdict(session.explain(a.dataset, a.sql)), indent=1, default=str))
        elif a.command == "summary":
            print(json.dumps(session.summary(a.dataset).to_dict(), indent=1, default=str))
        else:
            print(json.dumps(session.history(), indent=1, default=str))
        return 0
    except EngineError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
