"""Consecutive numbers within a key whose rows may be many."""

from pyspark.sql import Window
from pyspark.sql import functions as F


def number_in_order(df, keys, coarse, fine, name):
    """Number rows per keys from 1 in the order ``coarse`` then ``fine``.

    ``coarse`` holds (alias, column) pairs sorted ascending that cut a key's rows
    into consecutive runs. Runs are numbered on their own and shifted by the
    prefix sum of the run sizes, so no key is sorted in one task.
    """
    runs = [alias for alias, _ in coarse]
    cut = df.withColumns(dict(coarse))
    sizes = cut.groupBy(*keys, *runs).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(*runs).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*keys, *runs, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift"))
    within = Window.partitionBy(*keys, *runs).orderBy(*fine)
    return (
        cut.withColumn("_place", F.row_number().over(within))
        .join(shifts, [*keys, *runs])
        .withColumn(name, F.col("_place") + F.col("_shift"))
        .drop("_place", "_shift", *runs)
    )
