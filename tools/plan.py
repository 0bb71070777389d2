"""Print the physical plan tree (formatted explain, tree part only) of registered queries.

usage: python tools/plan.py sf_dir name [name ...]
"""

from __future__ import annotations

import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from regspark.plans.catalog import QUERIES  # noqa: E402
from regspark.session import get_spark  # noqa: E402


def main() -> None:
    spark = get_spark("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1]
    for n in sys.argv[2:]:
        df = QUERIES[n](spark, sf_dir)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")  # noqa: SLF001
        print(f"===== {n}")
        print(text.split("\n\n")[0])


if __name__ == "__main__":
    main()
