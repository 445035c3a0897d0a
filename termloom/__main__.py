"""``python -m termloom FOLDER TEXT``: classify one text by the lists of a folder and print JSON."""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from .operators.store import Catalog


def main(argv: list[str]) -> int:
    if len(argv) != 2:
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("termloom").getOrCreate()
    print(json.dumps(Catalog(spark, argv[0]).classify_text(argv[1]), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
