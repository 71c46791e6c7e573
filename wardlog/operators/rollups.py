"""Dashboards kept up to date: counts per batch of entries that merge, so that entries are not read again."""

from pyspark.sql import functions as F

from wardlog.operators.dashboard import COUNTERS, FACETS, HOUR_COUNTS, counted_hours, dashboard_of_counts, facet_counts

# 2**12 registers: a standard error of about 1.6 %
SKETCH_BITS = 12


def write_rollup(entries, folder, batch_id):
    """Counts of a batch: per job and hour, per job, facet and value, and a sketch of each job's addresses. A batch that
    comes again replaces its counts."""
    place = lambda table: f"{folder}/{table}/batch_id={batch_id}"
    counted_hours(entries).write.mode("overwrite").parquet(place("hours"))
    counts = facet_counts(entries, list(FACETS))
    counts.write.mode("overwrite").parquet(place("facets"))
    # the facets name every address of the batch once
    addresses = entries.sparkSession.read.schema(counts.schema).parquet(place("facets")).filter("facet = 'source_ip'")
    sketches = addresses.groupBy("job_id").agg(F.hll_sketch_agg("value", SKETCH_BITS).alias("addresses"))
    sketches.write.mode("overwrite").parquet(place("sketches"))


def read_hours(spark, folder):
    """Counters per job and hour over all batches."""
    hours = spark.read.parquet(f"{folder}/hours")
    return hours.groupBy("job_id", "hour").agg(*[F.sum(c).alias(c) for c in [*COUNTERS, *HOUR_COUNTS]])


def read_facets(spark, folder):
    """Counts per job, facet and value over all batches."""
    return spark.read.parquet(f"{folder}/facets").groupBy("job_id", "facet", "value").agg(F.sum("count").alias("count"))


def dashboard_of_rollups(spark, folder, alerts):
    """The dashboard of all batches; entries are not read."""
    return dashboard_of_counts(read_hours(spark, folder), read_facets(spark, folder), alerts)


def estimated_addresses(spark, folder):
    """job_id and its number of distinct addresses, estimated from the batches' sketches. The dashboard's own number is
    exact."""
    sketches = spark.read.parquet(f"{folder}/sketches")
    return sketches.groupBy("job_id").agg(F.hll_sketch_estimate(F.hll_union_agg("addresses")).alias("estimated_ips"))
