"""Address reputation from provider tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.functions.ip import canonical_ip, is_public_ip
from wardlog.functions.text import case
from wardlog.functions.times import micros
from wardlog.operators.sliding import slice_of

ABUSE_FIELDS = {
    "abuse_confidence_score": "int", "total_reports": "int", "country_code": "string", "isp": "string",
    "usage_type": "string", "last_reported_at": "string", "is_whitelisted": "boolean",
}
COUNTS = ["harmless", "malicious", "suspicious", "undetected", "timeout"]
VT_FIELDS = {**{c: "int" for c in COUNTS}, "reputation": "int", "country": "string", "as_owner": "string"}
ABUSE_URL = "https://www.abuseipdb.com/check/"
VT_URL = "https://www.virustotal.com/gui/ip-address/"


def public_ips(entries):
    """Distinct public source addresses in canonical form."""
    return (
        entries.select("source_ip").distinct()
        .filter(is_public_ip(F.col("source_ip")))
        .select(canonical_ip(F.col("source_ip")).alias("ip"))
        .distinct()
    )


def _latest(records, fields, now, ttl_seconds):
    """The newest record per address that is not older than the time to live."""
    valid = records.filter(
        (F.col("checked_at") <= now) & (F.unix_micros(F.col("checked_at")) >= F.unix_micros(now) - ttl_seconds * 1_000_000)
    )
    column = lambda name, kind: (
        F.col(name) if name in records.columns else F.lit(None)
    ).cast(kind).alias(name)
    status = F.col("http_status") if "http_status" in records.columns else F.lit(200)
    return valid.groupBy("ip").agg(
        F.max_by(
            F.struct(*[column(n, k) for n, k in fields.items()], status.cast("int").alias("http_status")),
            "checked_at",
        ).alias("record")
    )


def enrich_ips(ips, abuse=None, vt=None, now=None, ttl_seconds=3600):
    """Addresses with the valid records of both providers, as structs or null.

    The provider tables hold ip, checked_at and the provider's fields, and may
    hold http_status: 404 of the second provider means all counts 0, another
    failure gives no record. Whether a table is broadcast is left to Spark,
    which knows its size when it runs.
    """
    now = F.current_timestamp() if now is None else F.lit(now)
    out = ips
    for name, table, fields in (("abuse", abuse, ABUSE_FIELDS), ("virustotal", vt, VT_FIELDS)):
        if table is None:
            out = out.withColumn(f"{name}_record", F.lit(None))
        else:
            # providers may spell an IPv6 address otherwise than the entries
            table = table.withColumn("ip", F.coalesce(canonical_ip(F.col("ip")), F.col("ip")))
            latest = _latest(table, fields, now, ttl_seconds).withColumnRenamed("record", f"{name}_record")
            out = out.join(latest, "ip", "left")
    a, v = F.col("abuse_record"), F.col("virustotal_record")
    none = lambda fields, link: F.lit(None).cast(
        "struct<" + ",".join(f"{n}:{k}" for n, k in fields.items()) + f",{link}:string>"
    )
    if abuse is None:
        abuse_column = none(ABUSE_FIELDS, "report_url")
    else:
        values = [
            F.coalesce(a[n], F.lit(0)).alias(n) if k == "int"
            else F.coalesce(a[n], F.lit(False)).alias(n) if k == "boolean" else a[n].alias(n)
            for n, k in ABUSE_FIELDS.items()
        ]
        abuse_column = F.when(
            a["http_status"] == 200, F.struct(*values, F.concat(F.lit(ABUSE_URL), "ip").alias("report_url"))
        )
    if vt is None:
        vt_column = none(VT_FIELDS, "analysis_url")
    else:
        found = v["http_status"] == 200
        values = [F.coalesce(F.when(found, v[c]), F.lit(0)).alias(c) for c in COUNTS]
        values += [F.when(found, v[c]).alias(c) for c in ("reputation", "country", "as_owner")]
        vt_column = F.when(
            v["http_status"].isin(200, 404), F.struct(*values, F.concat(F.lit(VT_URL), "ip").alias("analysis_url"))
        )
    failed = lambda record, good, label: F.when(
        ~record["http_status"].isin(*good), F.concat(F.lit(f"{label}: HTTP "), record["http_status"].cast("string"))
    )
    errors = []
    if abuse is not None:
        errors.append(failed(a, [200], "AbuseIPDB"))
    if vt is not None:
        errors.append(failed(v, [200, 404], "VirusTotal"))
    return out.select(
        "ip",
        F.lit(abuse is not None).alias("configured_abuseipdb"),
        F.lit(vt is not None).alias("configured_virustotal"),
        abuse_column.alias("abuseipdb"),
        vt_column.alias("virustotal"),
        (F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")).alias("errors"),
    )


def reputation_band(score):
    """Colour of an abuse score."""
    return case([(score >= 75, "red"), (score >= 25, "amber")], "green")


def records_at(events, records, ttl_seconds=3600, time="event_time", address="source_ip"):
    """events with ``record``: the newest record of their address that was checked at or before the event and not more
    than ``ttl_seconds`` before it, or null.

    ``records`` has ip, checked_at and any other fields. Events and records of an address are put in one order, and the
    last record is carried forward. An address is cut into slices as long as the time to live; a record goes to its own
    slice and the next, behind which it is no longer valid, so an address with very many events is many tasks. Of
    records of one moment the one with the largest fields counts. Events without time or address have no record.
    """
    ttl = int(ttl_seconds * 1_000_000)
    spelled = lambda name: F.coalesce(canonical_ip(F.col(name)), F.col(name))
    fields = [F.col(f"`{c}`") for c in records.columns if c not in ("ip", "checked_at")]
    checked = records.select(
        spelled("ip").alias("ip"), micros(F.col("checked_at")).alias("us"), F.struct("checked_at", *fields).alias("record")
    ).filter("ip is not null and us is not null").withColumn("slice", slice_of("us", ttl))
    checked = checked.withColumn("slice", F.explode(F.array(F.col("slice"), F.col("slice") + 1)))
    asked = events.select(
        F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("event"),
        spelled(address).alias("ip"), micros(F.col(time)).alias("us"),
    ).withColumn("slice", slice_of("us", ttl))
    both = asked.filter("ip is not null and us is not null").unionByName(checked, True)
    order = Window.partitionBy("ip", "slice").orderBy("us", F.col("event").isNotNull(), "record")
    carried = F.last(F.when(F.col("record").isNotNull(), F.struct("us", "record")), ignorenulls=True)
    found = both.withColumn(
        "newest", carried.over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ).filter("event is not null")
    valid = F.when(F.col("us") - F.col("newest.us") <= ttl, F.col("newest.record"))
    rest = asked.filter("ip is null or us is null")
    kind = checked.schema["record"].dataType
    return found.select("event.*", valid.alias("record")).unionByName(
        rest.select("event.*", F.lit(None).cast(kind).alias("record"))
    )
