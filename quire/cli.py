"""spark-submit quire/cli.py PATH [--mode semantic|lossless] [--out FOLDER]: render packages."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quire.sources import packages


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("path")
    parser.add_argument("--mode", choices=("semantic", "lossless"), default="semantic")
    parser.add_argument("--out", help="Parquet folder; without it, texts are printed")
    given = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    out = packages.rendered(packages.scan(spark, given.path), given.mode)
    if given.out:
        out.write.parquet(given.out)
    else:
        for row in out.toLocalIterator():
            print(row["words_xml"])


if __name__ == "__main__":
    main()
