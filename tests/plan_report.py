"""Look for plan shapes that do not scale: python tests/plan_report.py FOLDER [name prefix ...]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusgauge.registry import all_queries  # noqa: E402
from corpusgauge.session import local_session  # noqa: E402

SHAPES = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def main() -> int:
    folder, wanted = sys.argv[1], tuple(sys.argv[2:])
    spark, bad = local_session(), 0
    for name, query in all_queries().items():
        if wanted and not name.startswith(wanted):
            continue
        plan = query.run(spark, folder)._jdf.queryExecution().executedPlan().toString()
        found = [s for s in SHAPES if s in plan]
        bad += bool(found)
        if found:
            print(name, found, flush=True)
    print("queries with such shapes:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
