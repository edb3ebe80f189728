"""One digest of many rows as a tree of hashes, whatever their order and partitioning.

Rows are known by their SHA-256. The tree follows the hashes' own digits, three for each level, and has as many levels
as the number of rows asks for, so that a leaf holds about ``LEAF`` hashes or fewer and a node at most 4,096 children.
No task and no row ever holds more; each level is one grouped pass over a 1,024th of the one before, or less.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAF, DIGITS, MOST_LEVELS = 1024, 3, 8


def levels(n: Column) -> Column:
    """Levels of a tree over ``n`` rows: the least for which leaves hold ``LEAF`` on average."""
    out = F.lit(MOST_LEVELS)
    for k in reversed(range(MOST_LEVELS)):
        out = F.when(n <= float(LEAF) * 16.0 ** (DIGITS * k), k).otherwise(out)
    return out


def tree_digest(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, n, name) from (keys, h): of each key's hashes, which are 64 hexadecimal digits and expected to differ.

    A tree of one key does not depend on the other keys. Keys without rows give none.
    """
    keys = keys or ["_all"]
    rows = rows if keys != ["_all"] else rows.withColumn("_all", F.lit(0))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_deep", levels(F.col("n")))
    deepest = counts.agg(F.max("_deep")).first()[0] or 0
    # a row for each key
    at = rows.select(*keys, F.col("h").alias("_path"), F.col("h").alias("_value")).join(counts, keys)
    joined = F.sha2(F.array_join(F.array_sort(F.collect_list("_value")), ""), 256)
    for level in range(deepest, 0, -1):
        here = at.where(F.col("_deep") >= level).withColumn("_path", F.substring("_path", 1, DIGITS * level))
        made = here.groupBy(*keys, "n", "_deep", "_path").agg(joined.alias("_value")).withColumn("_value", F.concat("_path", "_value"))
        at = made.unionByName(at.where(F.col("_deep") < level).select(*made.columns))
    out = at.groupBy(*keys, "n").agg(joined.alias(name))
    return out.drop("_all")
