"""Compare queries with their SQL: python tests/check_all.py FOLDER [name prefix ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusgauge.registry import all_queries  # noqa: E402
from corpusgauge.session import local_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main() -> int:
    folder, wanted = sys.argv[1], tuple(sys.argv[2:])
    spark, con = local_session(), connect(folder)
    bad = 0
    for name, query in all_queries().items():
        if wanted and not name.startswith(wanted):
            continue
        start = time.time()
        try:
            rows, problem = compare(spark, con, folder, query)
        except Exception as error:  # report and go on with the next query
            rows, problem = 0, f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        if query.sql is None and problem is None:
            mark = "rows"
        print(f"{mark} {name} rows={rows} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
