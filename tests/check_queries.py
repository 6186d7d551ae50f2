"""Compare registered queries with their SQL: ``python tests/check_queries.py DIR [NAME-PREFIX …]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from sevfold.queries import ORACLES, QUERIES
from tests.oracle import compare, connect, spent


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]").appName("check").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, build in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        spent["spark"] = 0.0
        try:
            df = build(spark, sf_dir)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else None
            note = "same" if name in ORACLES else f"rows only: {df.count()}"
        except Exception as e:
            problem, note = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:38s} {time.time() - start:6.2f}s ({spent['spark']:.1f} Spark) {problem or note}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
