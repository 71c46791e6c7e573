"""Secret scans: base patterns, and weak candidates linked by an interval join.

Three patterns are always reported. Account names, random-looking strings and endpoints are weak: each
is reported only if a part that completes it stands near it in the same document. An account name needs a
secret, a random string an identifier, an endpoint both. Nearness is an interval join on cells of the text.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.tables import stored
from wardlog.llm.text import text_or_empty

BROADCAST_ROWS = 500_000
REACH = 200
CELL = 256
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2

# kind: (pattern, cheap necessary test, group to measure, least length, role, weak)
PATTERNS = {
    "assign": (
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "[:=]", 2, 8, SECRET, False,
    ),
    "access": (r"AKIA[A-Z0-9]+", "AKIA", 0, 16, IDENTIFIER, False),
    "hex": (r"[0-9a-f]{32,}", r"[0-9a-f]{32}", 0, 32, SECRET, False),
    "account": (
        r"""(?i)(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""",
        "[:=]", 2, 3, IDENTIFIER, True,
    ),
    "random": (r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+/_-]{20}", 0, 20, SECRET, True),
    "endpoint": (
        r"""(?i)(https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+""",
        "://", 0, 8, ENDPOINT, True,
    ),
}
KINDS = list(PATTERNS)
BASE = [kind for kind, rule in PATTERNS.items() if not rule[5]]
KEY = ["doc_id", "text_key"]


def measure(kind, value):
    """Length of the value; 0 for a random string without a digit and both cases."""
    if kind != "random":
        return F.length(value)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    return F.when(mixed, F.length(value)).otherwise(0)


def matches(kind):
    """Array of (before, match, value) of a kind: the text between matches gives their places."""
    pattern, needed, group, *_ = PATTERNS[kind]
    found = F.arrays_zip(
        F.split("text", pattern).alias("before"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("match"),
        F.regexp_extract_all("text", F.lit(pattern), F.lit(group)).alias("value"),
    )
    sizes = F.transform(
        F.filter(found, lambda x: x["match"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            i.alias("number"),
            F.length(x["before"]).alias("gap"),
            F.length(x["match"]).alias("size"),
            measure(kind, x["value"]).alias("measure"),
        ),
    )
    test = F.col("text").rlike(needed) if "[" in needed else F.contains("text", F.lit(needed))
    return F.when(test, sizes).otherwise(
        F.array().cast("array<struct<kind:int,number:int,gap:int,size:int,measure:int>>")
    )


def looked_up(values):
    """The value of a kind number, as a column."""
    return F.element_at(F.array(*map(F.lit, values)), F.col("kind") + 1)


def all_parts(docs):
    """key, kind, start, end (code points), role, weak: every match that is long enough.

    A weak part that overlaps a base span is that span, and is left out.
    """
    rows = (
        docs.select("doc_id", F.xxhash64("text").alias("text_key"), text_or_empty().alias("text"))
        .select(*KEY, F.concat(*map(matches, KINDS)).alias("parts"))
        .where(F.size("parts") > 0)
        .dropDuplicates(KEY)
        .select(*KEY, F.inline("parts"))
    )
    so_far = Window.partitionBy(*KEY, "kind").orderBy("number")
    long_enough = F.col("measure") >= looked_up([rule[3] for rule in PATTERNS.values()])
    placed = (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far))
        .where(long_enough)
        .select(
            *KEY, "kind", (F.col("end") - F.col("size")).alias("start"), "end",
            looked_up([rule[4] for rule in PATTERNS.values()]).alias("role"),
            looked_up([rule[5] for rule in PATTERNS.values()]).alias("weak"),
        )
    )
    base_end = F.when(~F.col("weak"), F.col("end"))
    base_start = F.when(~F.col("weak"), F.col("start"))
    order = Window.partitionBy(*KEY).orderBy("start", "kind")
    return (
        placed.withColumn("base_before", F.max(base_end).over(order))
        .withColumn("base_after", F.min(base_start).over(order.rowsBetween(0, Window.unboundedFollowing)))
        .where("not weak or (coalesce(base_before <= start, true) and coalesce(base_after >= end, true))")
        .drop("base_before", "base_after")
    )


def cells(start, end):
    return F.explode(F.sequence(F.floor(start / CELL), F.floor(end / CELL)))


def linked(parts, reach=REACH):
    """Weak parts near parts that complete them; an interval join on (document, cell)."""
    weak = parts.where("weak").select(
        *KEY, "kind", "start", "end", "role", cells(F.col("start"), F.col("end")).alias("cell")
    )
    other = parts.select(
        *[F.col(k).alias(f"other_{k}") for k in KEY],
        F.col("start").alias("other_start"),
        F.col("end").alias("other_end"),
        F.col("role").alias("other_role"),
        cells(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach).alias("other_cell"),
    )
    near = (
        weak["doc_id"].eqNullSafe(F.col("other_doc_id"))
        & weak["text_key"].eqNullSafe(F.col("other_text_key"))
        & (F.col("cell") == F.col("other_cell"))
        & (F.col("role") != F.col("other_role"))
        & (F.col("other_start") - F.col("end") <= reach)
        & (F.col("start") - F.col("other_end") <= reach)
    )
    has = {role: F.max(F.col("other_role") == role) for role in (IDENTIFIER, SECRET)}
    return (
        weak.join(other, near)
        .groupBy(*KEY, "kind", "start", "end", "role")
        .agg(has[IDENTIFIER].alias("identifier"), has[SECRET].alias("secret"))
        .where(
            ((F.col("role") == IDENTIFIER) & F.col("secret"))
            | ((F.col("role") == SECRET) & F.col("identifier"))
            | ((F.col("role") == ENDPOINT) & F.col("identifier") & F.col("secret"))
        )
        .select(*KEY, "kind", "start", "end")
    )


def span_text(spans):
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1),
                                                 s["start"], s["end"])),
        ",",
    )


def secret_spans(docs, reach=REACH):
    """key and spans (sorted array of start, kind, end) of the documents that have any."""
    parts = all_parts(docs)
    base = parts.where("not weak").select(*KEY, "kind", "start", "end")
    return (
        base.unionByName(linked(parts, reach))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    )


def with_spans(rows, docs, reach=REACH):
    """Rows that have the key, with their spans (an empty array where there are none).

    Documents with spans are broadcast up to BROADCAST_ROWS of them.
    """
    spans = stored(secret_spans(docs, reach), "secret-spans")
    empty = F.array().cast(spans.schema["spans"].dataType)
    found = spans.select(*[F.col(k).alias(f"found_{k}") for k in KEY], "spans")
    on = [rows[k].eqNullSafe(F.col(f"found_{k}")) for k in KEY]
    found = F.broadcast(found) if spans.count() <= BROADCAST_ROWS else found
    return rows.join(found, on, "left").select(*rows.columns, F.coalesce("spans", empty).alias("spans"))


def secret_scan(docs, reach=REACH):
    """One row per document row: counts of base matches, their digest, and all spans.

    docs has doc_id and text; other columns are ignored. A null text is empty and has no span. Places are
    code points, the end exclusive. Rows that repeat get equal results; an empty table gives no rows.
    """
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    return with_spans(keys, docs, reach).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


def redact(docs, mark="[secret]", reach=REACH):
    """The documents with each reported span of text replaced by a mark; other texts stay as they are."""
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns])
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), whole.alias("row"))
    source = F.col("row.text")
    # overlapping spans are one: a span starts a new cut if all before it have ended
    step = F.struct(F.lit("").alias("text"), F.lit(0).cast("bigint").alias("at"))
    cut = F.aggregate(
        "spans",
        step,
        lambda done, s: F.when(
            s["start"] >= done["at"],
            F.struct(
                F.concat(done["text"], F.substr(source, (done["at"] + 1).cast("int"), (s["start"] - done["at"]).cast("int")),
                         F.lit(mark)).alias("text"),
                s["end"].alias("at"),
            ),
        ).otherwise(F.struct(done["text"].alias("text"), F.greatest(done["at"], s["end"]).alias("at"))),
        lambda done: F.concat(done["text"], F.substr(source, (done["at"] + 1).cast("int"))),
    )
    text = F.when(F.size("spans") > 0, cut).otherwise(source)
    return with_spans(rows, docs, reach).select(
        *[text.alias(name) if name == "text" else F.col("row")[name].alias(name) for name in docs.columns]
    )
