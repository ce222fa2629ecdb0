"""Command line: ``python -m tidegauge analyse DIR`` and ``python -m tidegauge concat --path DIR [--prefix P] [--suffix S] [--delete]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidegauge")
    jobs = parser.add_subparsers(dest="job", required=True)
    a = jobs.add_parser("analyse", help="analyse a folder of collected files")
    a.add_argument("folder")
    a.add_argument("--out", help="where the tables go (default: FOLDER/analysis)")
    a.add_argument("--format", default="bb", choices=["bb", "fb"])
    a.add_argument("--hosts", nargs="*")
    c = jobs.add_parser("concat", help="one CSV per source and category, and one of the descriptor mappings")
    c.add_argument("--path", required=True)
    c.add_argument("--prefix", default="")
    c.add_argument("--suffix", default="")
    c.add_argument("--delete", action="store_true", help="delete the files taken in")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("tidegauge").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.job == "analyse":
        from tidegauge.plans.directory import analyse

        for name, path in analyse(spark, args.folder, args.out or f"{args.folder}/analysis", args.format, args.hosts).items():
            print(name, path)
    else:
        from tidegauge.sources.csvfiles import concatenate

        for path in concatenate(spark, args.path, args.prefix, args.suffix, args.delete):
            print(path)


if __name__ == "__main__":
    main()
