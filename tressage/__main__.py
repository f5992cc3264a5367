"""Command line: ``python -m tressage list`` and ``python -m tressage run QUERY... --data FOLDER --out FOLDER``."""

from __future__ import annotations

import argparse
import importlib
import sys

from . import plans


def _queries() -> dict:
    try:
        return plans.queries() | importlib.import_module(f"{__package__}.llm.queries").queries()
    except ModuleNotFoundError as e:
        if (e.name or "").startswith(f"{__package__}.llm"):
            return plans.queries()
        raise


def main(argv: list[str] | None = None, spark=None) -> int:
    """Each query becomes a folder of Parquet files; one that is complete is left alone unless ``--force``."""
    parser = argparse.ArgumentParser(prog=__package__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="the names of the queries")
    run = commands.add_parser("run", help="write the results of queries")
    run.add_argument("queries", nargs="+")
    run.add_argument("--data", required=True, help="folder of NAME.parquet tables")
    run.add_argument("--out", required=True, help="folder of the results")
    run.add_argument("--force", action="store_true", help="write again what is complete")
    args, known = parser.parse_args(argv), _queries()
    if args.command == "list":
        print("\n".join(sorted(known)))
        return 0
    if unknown := [q for q in args.queries if q not in known]:
        print(f"unknown: {', '.join(unknown)}", file=sys.stderr)
        return 2
    if spark is None:
        from .session import local_session

        spark = local_session()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for q in args.queries:
        done = jvm.org.apache.hadoop.fs.Path(f"{args.out}/{q}/_SUCCESS")
        if done.getFileSystem(conf).exists(done) and not args.force:
            print(f"{q}: complete")
            continue
        known[q](spark, args.data).write.mode("overwrite").option("compression", "zstd").parquet(f"{args.out}/{q}")
        print(f"{q}: written")
    return 0


if __name__ == "__main__":
    sys.exit(main())
