"""Summarise the physical plans of the headline queries: scans (read schema, pushed
filters), exchanges (columns moved) and joins. Writes Markdown to stdout.

Usage: python scripts/plan_summary.py [sf_dir] [name ...]
"""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from wearline.plans import catalog  # noqa: E402
from wearline.session import get_spark  # noqa: E402


def summary(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    text = df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    fmt = df._jdf.queryExecution().explainString(text)
    scans = len(re.findall(r"^\(\d+\) Scan parquet", fmt, re.M))
    cached = len(re.findall(r"^\(\d+\) InMemoryTableScan", fmt, re.M))
    ex = re.findall(r"^\(\d+\) Exchange\s*\nInput \[(\d+)\]", fmt, re.M)
    bex = len(re.findall(r"^\(\d+\) BroadcastExchange", fmt, re.M))
    smj = len(re.findall(r"^\(\d+\) SortMergeJoin", fmt, re.M))
    bhj = len(re.findall(r"^\(\d+\) BroadcastHashJoin", fmt, re.M))
    pushed = sorted(set(re.findall(r"PushedFilters: (\[.*?\])", fmt)) - {"[]"})
    del plan
    return scans, cached, [int(x) for x in ex], bex, smj, bhj, pushed


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or HEADLINE
    spark = get_spark("local[8]", 8)
    catalog.load_all()
    print("| query | parquet scans | cached scans | shuffles (columns moved) | broadcasts | sort-merge joins | "
          "broadcast joins | pushed filters |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- |")
    for n in names:
        s = summary(catalog.QUERIES[n](spark, sf))
        print(f"| `{n}` | {s[0]} | {s[1]} | {len(s[2])} ({', '.join(map(str, s[2]))}) | {s[3]} | {s[4]} | {s[5]} | "
              f"{'; '.join(s[6]) or '-'} |")


if __name__ == "__main__":
    main()
