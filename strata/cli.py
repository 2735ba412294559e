"""python -m strata.cli ROOT sql|export|upgrade|rollback|vacuum|version ..."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from strata.errors import StrataError
from strata.session import Database


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="strata")
    p.add_argument("root")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("sql")
    q.add_argument("text")
    q.add_argument("--all-rows", action="store_true", help="allow UPDATE and DELETE without WHERE")
    e = sub.add_parser("export")
    e.add_argument("form", choices=("json", "csv", "sqlite", "postgres"))
    e.add_argument("--out")
    sub.add_parser("upgrade")
    sub.add_parser("rollback").add_argument("version", type=int)
    sub.add_parser("vacuum")
    sub.add_parser("version")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("strata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        _run(Database(spark, a.root), a)
    except StrataError as err:
        print(err, file=sys.stderr)
        return 1
    return 0


def _run(db: Database, a) -> None:
    if a.command == "sql":
        began = time.time()
        out = db.query(a.text, allow_full_table=a.all_rows)
        if isinstance(out, DataFrame):
            out.show(200, truncate=False)
            stats = db.last_query_stats
            print(f"{(time.time() - began) * 1000:.0f} ms, {stats.chunks_fetched}/{stats.chunks_total} chunks")
        else:
            print(f"{out} rows, version {db.current_version()}")
    elif a.command == "export":
        made = db.export(a.form, a.out)
        text = made if isinstance(made, str) else json.dumps(made) if a.form == "json" else "\n".join(f"-- {t}\n{c}" for t, c in made.items())
        print(text)
    elif a.command == "rollback":
        print(f"version {db.rollback_to(a.version)}")
    elif a.command == "vacuum":
        print(json.dumps(db.vacuum()))
    elif a.command == "upgrade":
        print("format {format}, version {version}".format(**db.upgrade()))
    else:
        print(db.current_version())


if __name__ == "__main__":
    sys.exit(main())
