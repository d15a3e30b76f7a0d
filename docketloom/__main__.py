"""Run a registered query, or the corpus build: python -m docketloom QUERY|build FOLDER OUT."""

from __future__ import annotations

import sys

from docketloom import pipeline
from docketloom.plans import catalogue
from docketloom.session import build_session


def main(args: list[str]) -> int:
    if len(args) != 3:
        print(__doc__, "\nQueries:", *sorted(catalogue.queries()))
        return 2
    name, folder, out = args
    spark = build_session("docketloom")
    if name == "build":
        print(*pipeline.build(spark, folder, out))
    else:
        catalogue.queries()[name](spark, folder).write.mode("overwrite").parquet(out)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
