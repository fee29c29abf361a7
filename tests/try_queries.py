"""Prints agreement and time of the named queries (all by default): python tests/try_queries.py [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402
from forecastops.catalog import ORACLES, QUERIES  # noqa: E402
from forecastops.session import build_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    patterns = sys.argv[1:]
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                         "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle.connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            problems = oracle.differences(df, con, ORACLES[name]) if name in ORACLES else []
            n = "" if name in ORACLES else f" rows-only {df.count()}"
        except Exception as error:
            problems, n = [f"{type(error).__name__}: {str(error)[:600]}"], ""
        bad += bool(problems)
        print(f"{'BAD' if problems else 'ok '} {name} {time.time() - started:.1f}s{n}", *problems, sep="\n   ", flush=True)
    print("bad:", bad)
