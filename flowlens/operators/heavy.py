"""The most frequent values of a column, exactly, without grouping all of them.

One pass counts rows per hash bucket (``BUCKETS`` counters, mergeable, whatever
the number of values). A bucket's count bounds each of its values, so only the
values of the fullest buckets are counted one by one; when the k-th count found
is above the fullest bucket left out, nothing there can be among the first k.
Otherwise more buckets are taken, four times as many each time, in the end all
of them, which is the plain group-by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 65_536
FIRST = 256


def top_values(df: DataFrame, column: str, k: int, count: str = "count", buckets: int = BUCKETS,
               first: int = FIRST) -> DataFrame:
    """``(column, count)`` of the ``k`` most frequent non-NULL values, ties by
    value; ``df`` is read twice, as a rule."""
    spark = df.sparkSession
    rows = df.select(column).where(F.col(column).isNotNull()) \
        .withColumn("_bucket", F.pmod(F.xxhash64(column), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()        # `buckets` rows at most
    sizes.sort(key=lambda r: (-r["n"], r["_bucket"]))
    taken = first
    while True:
        chosen = spark.createDataFrame([(r["_bucket"],) for r in sizes[:taken]], "_bucket int")
        found = rows.join(F.broadcast(chosen), "_bucket", "left_semi").groupBy(column) \
            .agg(F.count(F.lit(1)).alias(count)).orderBy(F.desc(count), column).limit(k).collect()
        left = sizes[taken]["n"] if taken < len(sizes) else 0
        if left == 0 or (len(found) == k and found[-1][count] > left):
            break
        taken *= 4
    schema = f"`{column}` {df.schema[column].dataType.simpleString()}, {count} long"
    return spark.createDataFrame([tuple(r) for r in found], schema).orderBy(F.desc(count), column)
