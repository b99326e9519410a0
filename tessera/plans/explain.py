"""Print the formatted physical plan of a registered query and the facts
the design relies on (exchanges, join strategies, pushed filters, UDFs).

    python -m tessera.plans.explain q_customer_summary /root/testdata/sf0.1
"""

from __future__ import annotations

import re
import sys

from tessera.plans.inspect import check_plan, formatted_plan, physical_plan


def summary(df) -> str:
    plan = physical_plan(df)
    facts = check_plan(df)
    lines = [
        f"scans: {plan.count('FileScan parquet')}",
        f"exchanges: {len(re.findall(r'Exchange (hash|round|single|range)', plan))}",
        f"broadcast exchanges: {plan.count('BroadcastExchange')}",
        f"broadcast hash joins: {plan.count('BroadcastHashJoin')}",
        f"sort-merge joins: {plan.count('SortMergeJoin')}",
        f"python udf: {facts['python_udf']}",
        f"cartesian: {facts['cartesian']}",
    ]
    lines += ["pushed: " + p[p.index("PushedFilters"):][:200] for p in facts["pushed_filters"]]
    return "\n".join(lines)


def main() -> None:
    from tessera.registry import QUERIES
    from tessera.session import build_session
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    df = QUERIES[name](build_session(), sf_dir)
    print(summary(df))
    print()
    print(formatted_plan(df))


if __name__ == "__main__":
    main()
