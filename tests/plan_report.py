"""Print the shuffle / join / scan skeleton of registered queries' physical
plans, with broadcast joins disabled so the plan has the shape it takes when
no input fits the broadcast threshold (the 100 TB case).

Usage: python tests/plan_report.py [sf_dir] name ...  > PLANS.md
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.plans import registry  # noqa: E402
from tessera.session import build_session  # noqa: E402

KEEP = re.compile(r"(Exchange|Join|HashAggregate|ObjectHashAggregate|SortAggregate|Window|Generate|FileScan|"
                  r"TakeOrdered|Expand)")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            m = re.search(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: (\[[^\]]*\]?)", line)
            tbl = re.search(r"/([a-z]+)\.parquet", line)
            indent = line[: len(line) - len(line.lstrip())]
            line = f"{indent}+- FileScan {tbl.group(1) if tbl else '?'} cols=[{m.group(1) if m else ''}] " \
                   f"pushed={m.group(2) if m else '[]'}"
        out.append(line[:220])
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    spark = build_session(extra={"spark.sql.autoBroadcastJoinThreshold": "-1"})
    registry.load_all()
    for n in names:
        df = registry.QUERIES[n](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {n}\n\n```")
        print("\n".join(skeleton(plan)))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv)
