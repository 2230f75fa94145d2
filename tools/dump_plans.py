"""Write PLANS.md: the physical plan tree of every registered query (sf0.01 inputs).

Usage: python tools/dump_plans.py [sf_dir]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = []
    for line in plan.split("\n"):
        if not line.strip():
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        lines.append(line[:160])
    return "\n".join(lines)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from tamis.plans import catalog
    from tamis.session import get_spark
    spark = get_spark(8)
    out = ["# Physical plans", "",
           "Generated by `tools/dump_plans.py` from the registered queries (before AQE re-planning; the",
           "round-robin exchange at the top of text queries is `spread()`, present only because the test files have",
           "fewer splits than cores). Stream queries are shown as the batch read of their sink.", ""]
    for name, fn in catalog.queries().items():
        df = fn(spark, sf)
        out += [f"## {name}", "", "```", tree(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))


if __name__ == "__main__":
    main()
