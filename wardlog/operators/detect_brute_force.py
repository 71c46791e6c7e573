"""Bursts of refused logins from one address."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.text import case
from wardlog.functions.times import logged_text, micros
from wardlog.operators.alert import alert_rows, fixed_decimals, present, text
from wardlog.operators.sliding import sliding_counts, window_slots
from wardlog.session import stored

# Fixed values of the alert table: titles, descriptions, labels of the evidence, actions and the steps of the
# severity ladders below. They are written where they are used.
KEYS = ["job_id", "source_ip"]
SAMPLE = 10
BURST = ["count", "last_us", "at_last", "order_line", "success"]
# addresses whose refused logins carry no time are joined over this many salts
UNTIMED_SALTS = 32


def failed_logins(entries):
    """The refused logins with an address: five columns, written once, as bursts read them several times."""
    failures = entries.filter(F.col("event_type").isin(fixed.FAILED_LOGIN_TYPES) & present("source_ip")).select(
        *KEYS, micros(F.col("event_time")).alias("us"), F.col("event_time_local").alias("wall"), "line_number", "username"
    )
    return stored(failures, "failed-logins")


def find_bursts(entries, window_seconds=300, threshold=10):
    """Bursts among the failed logins of the entries; see bursts_among."""
    return bursts_among(failed_logins(entries), window_seconds, threshold)


def bursts_among(failures, window_seconds=300, threshold=10):
    """One row per address with a burst: count, first and last microsecond, and ``at_last``.

    Only the first row that reaches the threshold counts at each moment, so with
    p rows before and n rows at a moment the burst there has max(threshold, p + 1)
    rows, if p + n reaches the threshold. The largest burst is kept, the earliest
    of equal ones. ``at_last`` (at most the threshold) is how many rows of the
    last moment belong to it. Without any time the whole group is the burst.
    """
    window_us = int(window_seconds * 1_000_000)
    per_time = failures.groupBy(*KEYS, "us").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first_line")
    )
    groups = (
        per_time.groupBy(*KEYS)
        .agg(
            F.min("first_line").alias("order_line"),
            F.count("us").alias("timed"),
            F.sum("n").alias("failures"),
        )
        .filter(F.col("failures") >= threshold)
    )
    rolled = sliding_counts(per_time.filter("us is not null").select(*KEYS, "us", "n"), KEYS, window_us)
    before = F.col("in_window") - F.col("n")
    reached = rolled.filter(F.col("in_window") >= threshold).select(
        *KEYS, "us", F.greatest(F.lit(threshold).cast("long"), before + 1).alias("count"), before.alias("before")
    )
    timed = reached.groupBy(*KEYS).agg(
        F.max(F.struct("count", (-F.col("us")).alias("earliest"), "before")).alias("best")
    ).select(
        *KEYS,
        F.col("best.count").alias("count"),
        (-F.col("best.earliest")).alias("last_us"),
        (F.col("best.count") - F.col("best.before")).alias("at_last"),
    )
    return (
        groups.join(timed, KEYS, "left")
        .filter(F.col("count").isNotNull() | (F.col("timed") == 0))
        .select(*KEYS, F.coalesce("count", "failures").alias("count"), "last_us", "at_last", "order_line")
    )


def _members(failures, bursts, window_us, threshold):
    """The failed logins of the bursts, twice: ``inside`` has all of them, marked ``ending`` at the last moment (where
    only some belong to the burst); ``head`` has the first ones before it, and those at it that do belong.

    The columns of a burst travel with its rows, so that it need not be worked
    out again to be joined back.
    """
    slot = F.when(
        F.col("us").isNull(), F.pmod(F.col("line_number"), F.lit(UNTIMED_SALTS))
    ).otherwise(F.expr(f"(us - pmod(us, {window_us})) div {window_us}"))
    spread = bursts.withColumn("first_us", F.col("last_us") - window_us).select(
        *KEYS,
        F.col("last_us").isNotNull().alias("timed"),
        F.explode(
            F.when(
                F.col("last_us").isNull(), F.sequence(F.lit(0).cast("long"), F.lit(UNTIMED_SALTS - 1).cast("long"))
            ).otherwise(window_slots("first_us", "last_us", window_us))
        ).alias("slot"),
        "first_us",
        *BURST,
    )
    rows = failures.withColumns({"timed": F.col("us").isNotNull(), "slot": slot})
    inside = (
        rows.join(spread, [*KEYS, "timed", "slot"])
        .filter(~F.col("timed") | F.col("us").between(F.col("first_us"), F.col("last_us")))
        .withColumn("ending", F.coalesce(F.col("us") == F.col("last_us"), F.lit(False)))
    )
    # Enough first rows for the samples and for the rows of the last moment. The
    # bound on the rank lets every task keep only that many rows before the shuffle.
    order = Window.partitionBy(*KEYS, "ending").orderBy("us", "line_number")
    head = inside.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= max(threshold, SAMPLE)
    ).filter(~F.col("ending") | (F.col("rank") <= F.col("at_last")))
    return inside, head


def _names(inside, head):
    """One row per burst and name it tried."""
    return (
        inside.filter(~F.col("ending")).select(*KEYS, "username")
        .unionByName(head.filter("ending").select(*KEYS, "username"))
        .filter(present("username"))
        .distinct()
    )


def burst_targets(entries, window_seconds=300, threshold=10):
    """The names that each burst tried: one row per job, address and name, however many there are."""
    window_us = int(window_seconds * 1_000_000)
    failures = failed_logins(entries)
    bursts = stored(bursts_among(failures, window_seconds, threshold).withColumn("success", F.lit(False)), "bursts")
    return _names(*_members(failures, bursts, window_us, threshold))


def _with_members(failures, bursts, window_us, threshold, list_targets):
    """Bursts with their names, first line numbers, first time, and first and last wall clock."""
    inside, head = _members(failures, bursts, window_us, threshold)
    samples = head.groupBy(*KEYS).agg(
        F.transform(
            F.slice(F.array_sort(F.collect_list(F.struct("us", "line_number"))), 1, SAMPLE),
            lambda s: s["line_number"],
        ).alias("sample_lines"),
        F.min("us").alias("first_us"),
        F.min(F.struct("us", "line_number", "wall"))["wall"].alias("first_wall"),
        F.max(F.struct("us", "line_number", "wall"))["wall"].alias("last_wall"),
        *[F.first(c).alias(c) for c in BURST],
    )
    listed = F.array_sort(F.collect_list("username")) if list_targets else F.lit(None).cast("array<string>")
    names = _names(inside, head).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("target_count"), listed.alias("targets"))
    return samples.join(names, KEYS, "left")


def success_after(entries, bursts):
    """Bursts with ``success``: a login from the same address strictly after the last row."""
    logins = (
        entries.filter(F.col("event_type").isin(fixed.SUCCESS_LOGIN_TYPES) & present("source_ip"))
        .groupBy(*KEYS)
        .agg(F.max(micros(F.col("event_time"))).alias("login_us"))
    )
    return bursts.join(logins, KEYS, "left").withColumn(
        "success", F.coalesce(F.col("login_us") > F.col("last_us"), F.lit(False))
    ).drop("login_us")


def detect_brute_force(entries, window_seconds=300, threshold=10, created_at=None, list_targets=True):
    """One alert per address that was refused often enough within the window.

    The alert lists every name the burst tried. Where bursts may try very many
    names, ``list_targets=False`` puts their number in the place of the list;
    burst_targets gives them as rows.
    """
    window_us = int(window_seconds * 1_000_000)
    failures = failed_logins(entries)
    bursts = stored(success_after(entries, bursts_among(failures, window_seconds, threshold)), "bursts")
    rows = _with_members(failures, bursts, window_us, threshold, list_targets)
    logged = lambda at: logged_text(F.col(f"{at}_wall"), F.col(f"{at}_us"))
    named = F.coalesce("target_count", F.lit(0)) > 0
    seconds = F.coalesce((F.col("last_us") - F.col("first_us")) / 1e6, F.lit(0.0))
    count, ip, success = F.col("count"), F.col("source_ip"), F.col("success")
    joined = F.when(named, F.array_join("targets", ", ") if list_targets else text(F.col("target_count"), " names"))
    return alert_rows(
        rows,
        "brute_force",
        "brute_force",
        severity=case(
            [(success | (count >= 50), "critical"), (count >= 30, "high"), (count >= 20, "medium")], "low"
        ),
        title=text("Brute Force Attack from ", ip),
        description=text(
            "Detected ", count, " failed login attempts from IP ", ip, " within ",
            fixed_decimals(seconds, 0), " seconds. Target accounts: ",
            F.coalesce(joined, F.lit("unknown")), ".",
            F.when(
                success,
                " A SUCCESSFUL LOGIN was detected after the failures — possible credential compromise!",
            ),
        ),
        evidence=[
            count.alias("failed_attempts"),
            seconds.alias("duration_seconds"),
            F.coalesce("targets", F.array().cast("array<string>")).alias("target_accounts"),
            logged("first").alias("first_attempt"),
            logged("last").alias("last_attempt"),
            success.alias("success_after_failures"),
            F.col("sample_lines"),
            *([] if list_targets else [F.coalesce("target_count", F.lit(0)).alias("target_count")]),
        ],
        actions=[
            text("Block IP address ", ip, " immediately"),
            F.when(named, "Reset passwords for targeted accounts").otherwise("Review targeted accounts"),
            "Enable account lockout policies",
            "Enable multi-factor authentication",
            F.when(success, "Review successful login sessions from this IP").otherwise(
                "Monitor for successful login attempts"
            ),
        ],
        source_ip=ip,
        target_account=joined if list_targets else None,
        created_at=created_at,
    )
