"""Command line: python tests/check_queries.py [sf] [name prefix ...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from odflux.catalog import ORACLES, QUERIES  # noqa: E402
from odflux.session import build_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    sf_dir = f"/root/testdata/sf{sf}"
    conf = {} if "PLAIN" in os.environ else {"spark__sql__shuffle__partitions": "8", "spark__driver__memory": "8g"}
    spark = build_session(master="local[8]", spark__ui__showConsoleProgress="false", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, build in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = build(spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name in ORACLES:
                problem = difference(got, con.execute(ORACLES[name]).df())
            else:
                problem = None if len(got) else "no rows"
            state = "ok " if problem is None else "BAD"
        except Exception as error:  # noqa: BLE001
            took, state, got, problem = time.time() - start, "ERR", [], str(error)[:700]
        failed += state != "ok "
        print(f"{state} {name:38s} rows {len(got):6d} spark {took:6.2f}s sql {time.time() - start:5.2f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
