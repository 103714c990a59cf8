"""python -m coterie IN MINCOUNT [OUT] [--mode frequent|closed|maximal]: itemsets of a file of baskets.

Prints how many there are and how many of each length; writes itemset lines to the
folder OUT if it is given. The mode is frequent unless another is named.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.operators import mining, report
from coterie.sources.transactions import read_text


def mine_file(spark: SparkSession, path: str, count: int, out: str | None = None, mode: str = "frequent") -> list[int]:
    """Mines a file of lines, writes itemset lines if asked to, and returns how many sets each length has."""
    sets = mining.mine(read_text(spark, path), count, mode, True).persist()
    try:
        hist = report.length_histogram(sets).orderBy("len").collect()  # one row a length
        if out and sets.limit(1).count():
            report.write_lines(sets.orderBy(F.col("len")), out)
    finally:
        sets.unpersist()
    return [r["n"] for r in hist]


def lines_of_file(spark: SparkSession, path: str) -> DataFrame:
    """The itemsets of a folder that mine_file wrote."""
    return report.read_lines(spark, path)


def main(args: list[str]) -> int:
    args, mode = list(args), "frequent"
    if "--mode" in args:
        at = args.index("--mode")
        mode = args[at + 1] if at + 1 < len(args) else ""
        del args[at : at + 2]
    if len(args) not in (2, 3) or not args[1].isdigit() or int(args[1]) < 1 or mode not in mining.MODES:
        print(__doc__, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("coterie").getOrCreate()
    hist = mine_file(spark, args[0], int(args[1]), args[2] if len(args) == 3 else None, mode)
    print(sum(hist))
    for n in hist:
        print(n)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
