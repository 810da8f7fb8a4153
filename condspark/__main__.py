"""python -m condspark FOLDER TARGET: prunes a source tree for a target and prints each file below its banner."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import blocks, build, report
from .sources import files


def main() -> None:
    ask = argparse.ArgumentParser(description=__doc__)
    ask.add_argument("folder")
    ask.add_argument("target")
    ask.add_argument("--mode", choices=["physical", "virtual"], default="physical")
    given = ask.parse_args()
    spark = SparkSession.builder.appName("condspark").getOrCreate()
    rows = files.source_files(spark, given.folder).withColumn("target", F.lit(given.target)).withColumn("macros", build.target_macros(F.col("target")))
    for row in report.read(blocks.prune(rows, given.mode), "Conditional sources", given.mode).orderBy("path").toLocalIterator():
        print(f"== {row['path']}\n{row['text']}")


if __name__ == "__main__":
    main()
