"""Compare the training-data queries with their SQL: python tests/llm/run_sql.py [name ...] (SF_DIR names the tables)."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import oracle  # noqa: E402
from tickerloom import session  # noqa: E402
from tickerloom.llm.queries import ORACLES, QUERIES  # noqa: E402

if __name__ == "__main__":
    oracle.KIND["int"] = "INTEGER"
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session.local_session(8)
    for name in sys.argv[1:] or QUERIES:
        problem, rows, a, b = oracle.compare(spark, oracle.connect(folder), name, QUERIES[name], ORACLES.get(name), folder)
        print("BAD" if problem else "ok ", name, rows, f"{a:.1f}s {b:.1f}s", problem or "")
