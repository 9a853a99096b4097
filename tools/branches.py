"""PYTHONPATH=. python tools/branches.py [DIR]: which branches of the rule tables the planted texts of a table folder reach.

Exit status 2 if the check does not find its own known-bad case, 1 if word edges lock a branch out, else 0.
"""

import sys

from pyspark.sql import SparkSession

from wardline.operators import reach
from wardline.plans import catalogue


def main(args: list[str]) -> int:
    spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not reach.self_test(spark):
        print("the check does not find a branch that is known to be locked out")
        return 2
    texts = catalogue.planted(spark, args[0] if args else "/root/testdata/sf0.001").cache()
    verdicts = {name: check(spark, texts, catalogue.RULES).collect() for name, check in (("reach", reach.reachability), ("edges", reach.locked_out))}
    for name, rows in verdicts.items():
        for verdict in sorted({r["verdict"] for r in rows}):
            of = [f"{r['rule']}/{r['branch']}" for r in rows if r["verdict"] == verdict]
            print(f"{name}: {len(of)} {verdict}" + ("" if verdict in ("fires", "untested") else ": " + ", ".join(of)))
    print(f"{len(reach.unmeasured(catalogue.RULES))} rules have no alternation of their own, or several")
    return int(any(r["verdict"] == "locked_out" for r in verdicts["edges"]))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
