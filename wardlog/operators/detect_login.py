"""Suspicious logins: odd hours, many privileged names, success after a streak of failures."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog import fixed_values as fixed
from wardlog.functions.times import micros, plain_text
from wardlog.operators.alert import alert_rows, present, text
from wardlog.operators.sliding import slice_of
from wardlog.session import stored

# Fixed values of the alert table: titles, descriptions, labels of the evidence, actions and the steps of the
# severity ladders below. They are written where they are used.
# a user's events are cut into slices of this length, so no user is one task
STREAK_SLICE_US = 3600 * 1_000_000


def _privileged(accounts):
    return present("username") & F.lower("username").isin([a.lower() for a in accounts])


def detect_off_hours_login(entries, start=6, end=22, accounts=fixed.PRIVILEGED_ACCOUNTS, created_at=None):
    """One alert per privileged login before ``start`` or from ``end`` o'clock on."""
    hour = F.hour("event_time_local")
    rows = entries.filter(
        F.col("event_type").isin(fixed.SUCCESS_LOGIN_TYPES)
        & _privileged(accounts)
        & ((hour < start) | (hour >= end))
    )
    user, ip, wall = F.col("username"), F.nullif("source_ip", F.lit("")), F.col("event_time_local")
    return alert_rows(
        rows,
        "off_hours_login",
        "suspicious_login",
        severity=F.lit("high"),
        title=F.lit("Privileged Account Login Outside Working Hours"),
        description=text(
            "User '", user, "' logged in at ", F.date_format(wall, "HH:mm:ss"),
            f" (outside {start}:00-{end}:00 working hours)",
            F.concat(F.lit(" from IP "), ip), ". This may indicate unauthorized access.",
        ),
        evidence=[
            plain_text(wall).alias("login_time"), hour.alias("hour"), user.alias("account"),
            ip.alias("source_ip"), F.col("line_number"),
        ],
        actions=[
            text("Verify this login was authorized by the ", user, " account owner"),
            "Check for any lateral movement or privilege escalation",
            "Review session activity following this login",
            "Consider restricting privileged account access to working hours",
        ],
        source_ip=ip,
        target_account=user,
        order_line="line_number",
        created_at=created_at,
    )


def detect_multi_privileged(entries, min_accounts=2, accounts=fixed.PRIVILEGED_ACCOUNTS, created_at=None):
    """One alert per address that used several privileged names (spellings count apart)."""
    rows = (
        entries.filter(
            F.col("event_type").isin(fixed.PRIVILEGED_USE_TYPES) & _privileged(accounts) & present("source_ip")
        )
        .groupBy("job_id", "source_ip", "username")
        .agg(F.count(F.lit(1)).alias("logins"), F.min("line_number").alias("line"))
        .groupBy("job_id", "source_ip")
        .agg(
            F.array_sort(F.collect_list("username")).alias("names"),
            F.sum("logins").alias("login_count"),
            F.min("line").alias("order_line"),
        )
        .filter(F.size("names") >= min_accounts)
    )
    ip, names = F.col("source_ip"), F.array_join("names", ", ")
    return alert_rows(
        rows,
        "multi_privileged",
        "privilege_escalation",
        severity=F.lit("critical"),
        title=text("Multiple Privileged Account Access from ", ip),
        description=text(
            "IP ", ip, " accessed ", F.size("names"), " privileged accounts: ", names,
            ". This may indicate credential stuffing or lateral movement.",
        ),
        evidence=[F.col("names").alias("accounts"), F.col("login_count"), ip.alias("source_ip")],
        actions=[
            text("Block IP ", ip, " and investigate source"),
            "Reset passwords for all affected privileged accounts",
            "Audit all actions taken by these accounts",
            "Enable MFA for all privileged accounts",
        ],
        source_ip=ip,
        target_account=names,
        created_at=created_at,
    )


def failure_streaks(entries, min_failures=5):
    """Successful logins with the number of failures of that user since the success before.

    Within a time slice the streak is the running number of failures less its
    value at the last success. Only the first success of a slice also needs the
    failures carried over from earlier slices, which come from one summary row
    per user and slice.
    """
    is_failure = F.col("event_type").isin(fixed.STREAK_FAILURE_TYPES)
    logins = (
        entries.filter(
            F.col("event_type").isin(fixed.STREAK_FAILURE_TYPES + fixed.SUCCESS_LOGIN_TYPES)
            & present("username")
            & F.col("event_time").isNotNull()
        )
        .select(
            "job_id", "username", micros(F.col("event_time")).alias("us"), "line_number",
            is_failure.alias("failure"), "source_ip", "event_time_local",
        )
        .withColumn("slice", slice_of("us", STREAK_SLICE_US))
    )
    part = ["job_id", "username", "slice"]
    order = Window.partitionBy(*part).orderBy("us", "line_number")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = logins.withColumn("failures", F.sum(F.col("failure").cast("long")).over(upto)).withColumn(
        "at_success", F.max(F.when(~F.col("failure"), F.col("failures"))).over(earlier)
    )
    counted = stored(counted, "login-streaks")
    event = F.struct("us", "line_number", "source_ip", "event_time_local", "failures")
    first_success = ~F.col("failure") & F.col("at_success").isNull()
    slices = counted.groupBy(*part).agg(
        F.max("failures").alias("total"),
        F.max(F.when(~F.col("failure"), F.col("failures"))).alias("at_last_success"),
        F.max(F.when(first_success, event)).alias("first"),
    )
    before = (
        Window.partitionBy("job_id", "username").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = slices.withColumn("start", F.coalesce(F.sum("total").over(before), F.lit(0))).withColumn(
        "carried",
        F.col("start") - F.coalesce(F.max(F.col("start") + F.col("at_last_success")).over(before), F.lit(0)),
    )
    firsts = base.filter("first is not null").select(
        "job_id", "username", "first.us", "first.line_number", "first.source_ip", "first.event_time_local",
        (F.col("first.failures") + F.col("carried")).alias("streak"),
    )
    others = counted.filter(~F.col("failure") & F.col("at_success").isNotNull()).select(
        "job_id", "username", "us", "line_number", "source_ip", "event_time_local",
        (F.col("failures") - F.col("at_success")).alias("streak"),
    )
    return firsts.unionByName(others).filter(F.col("streak") >= min_failures)


def detect_login_after_failures(entries, min_failures=5, created_at=None):
    """One alert per successful login after at least ``min_failures`` failures of the user."""
    rows = failure_streaks(entries, min_failures)
    user, streak = F.col("username"), F.col("streak")
    ip, when = F.nullif("source_ip", F.lit("")), plain_text(F.col("event_time_local"))
    return alert_rows(
        rows,
        "login_after_failures",
        "suspicious_login",
        severity=F.lit("high"),
        title=text("Successful Login After ", streak, " Failures for '", user, "'"),
        description=text(
            "Account '", user, "' had ", streak,
            " consecutive failed login attempts before a successful login at ", when,
            ". This may indicate a successful brute-force or credential guessing attack.",
        ),
        evidence=[
            streak.alias("failure_count"), when.alias("success_time"), ip.alias("success_ip"), F.col("line_number"),
        ],
        actions=[
            text("Immediately investigate the session for user '", user, "'"),
            "Force password reset for this account",
            "Check for data access or lateral movement",
            "Enable MFA if not already enabled",
        ],
        source_ip=ip,
        target_account=user,
        order_line="line_number",
        created_at=created_at,
    )
