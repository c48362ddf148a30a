"""python -m quern [--data FOLDER] "SQL; SQL": runs statements, over the Parquet tables of a folder if one is named, and prints their rows."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from quern.engine import Engine, statements
from quern.session import session, views


def main() -> None:
    p = argparse.ArgumentParser(prog="quern")
    p.add_argument("script")
    p.add_argument("--data")
    p.add_argument("--rows", type=int, default=50, help="rows of a result to print")
    given = p.parse_args()
    spark = session()
    if given.data:
        views(spark, given.data)
    db = Engine(spark)
    for s in statements(given.script):
        out = db.execute(s)
        if isinstance(out, DataFrame):
            out.show(given.rows, truncate=False)
        else:
            print(f"{out} rows")


if __name__ == "__main__":
    main()
