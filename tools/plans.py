"""Print formatted physical plans of chosen registered queries (for review).

usage: python tools/plans.py key [key ...] > PLANS.txt
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from voxframe.plans import load_all
    from voxframe.session import get_spark
    spark = get_spark()
    q, _ = load_all()
    sf = os.environ.get("PLAN_SF_DIR", "/root/testdata/sf0.01")
    for k in sys.argv[1:]:
        df = q[k](spark, sf)
        print(f"==== {k}")
        print(df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))


if __name__ == "__main__":
    main()
