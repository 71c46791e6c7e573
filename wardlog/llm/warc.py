"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Archives are read in splits, cut at every magic. Each cut is only a candidate: its header gives the place where the
next record must begin. Pointer jumping from the start of each file keeps the records on that chain; a magic inside
a payload is on no chain, and its text belongs to the record around it.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from wardlog.llm.joins import lookup
from wardlog.llm.tables import shared_path, stored

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 20_000
KINDS = ("response", "revisit")


def base32_sha1(data):
    """Bare upper-case base32 of the SHA-1 of a binary column: each 5 hex digits are 4 letters."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(F.sha1(data), 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def page_records(pages, min_bytes=0):
    """pages with payload, its size and digest, record_type and refers_to.

    Of equal payloads of min_bytes or more, the smallest page_id is the response and the others refer to it; rows
    that repeat the smallest page_id are responses too. A null page_id refers to the smallest there is.
    """
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.encode("payload", "utf-8")).alias("payload_digest"),
    )
    # only payloads that occur twice need to be told: few rows, found without moving a payload
    repeated = stored(
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1 and first_id is not null")
        .select("payload_digest", "first_id"),
        "warc-repeated",
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return (
        lookup(rows, repeated, "payload_digest", "page_id")
        .withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
        .withColumn("refers_to", F.when(revisit, F.col("first_id")))
        .drop("first_id")
    )


def urn(column):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("none")), F.lit(">"))


def record_text(rows):
    """The record without its final END, which the text writer adds as its line separator."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return rows.withColumn("block", block).select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.col("record_type")),
            line("WARC-Record-ID", urn("page_id")),
            F.when(revisit, line("WARC-Refers-To", urn("refers_to"))).otherwise(""),
            line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
            line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
            line("Content-Type", F.lit("application/http; msgtype=response")),
            line("Content-Length", F.octet_length("block").cast("string")),
            F.lit("\r\n"),
            "block",
        ).alias("value")
    )


def write_archives(pages, path, min_bytes=0):
    """One record per row, in files of at most RECORDS_PER_FILE records; only finished tasks' files are kept."""
    record_text(page_records(pages, min_bytes)).write.option("lineSep", END).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


def chunks(spark, path):
    """The text between magics, with file, split and an order within the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"),
        "value",
        F.octet_length("value").cast("long").alias("bytes"),
    )


def in_file(frame):
    """`at`: the byte where the chunk's magic stands. The chunks and magics of a file tile it."""
    order = Window.partitionBy("file").orderBy("block", "number")
    before = F.coalesce(F.sum(F.col("bytes") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return frame.withColumn("at", before - len(MAGIC)).drop("block", "number")


def header_field(name, value):
    return F.regexp_extract("header", f"(?i)(?:^|\r\n){name}: *({value})(?=\r\n|$)", 1)


def parsed(frame):
    """Header fields of a record text, and its payload's digest if the text holds just this record."""
    body = F.encode("value", "utf-8")
    number = lambda text: F.expr(f"try_cast({text} as bigint)")
    return (
        frame.withColumn("header", F.when(F.instr("value", END) > 0, F.substring_index("value", END, 1)))
        .withColumn("_length", header_field("Content-Length", "[0-9]+"))
        .withColumn("_id", header_field("WARC-Record-ID", "<urn:page:[^>]*>"))
        .withColumn("_refers", header_field("WARC-Refers-To", "<urn:page:[^>]*>"))
        .withColumn("_told", header_field("WARC-Payload-Length", "[0-9]+"))
        .select(
            *frame.columns,
            header_field("WARC-Type", "[a-z]+").alias("record_type"),
            number("substring(_id, 11, length(_id) - 11)").alias("page_id"),
            number("substring(_refers, 11, length(_refers) - 11)").alias("refers_to"),
            number("_told").alias("told_bytes"),
            header_field("WARC-Payload-Digest", "sha1:[A-Z2-7]+").alias("told_digest"),
            (F.octet_length("header") + len(END)).cast("long").alias("header_bytes"),
            number("_length").alias("length"),
        )
        .withColumn("whole", F.coalesce(F.col("bytes") == F.col("header_bytes") + F.col("length") + len(END), F.lit(False)))
        .withColumn("http_bytes", F.octet_length(
            F.substring_index(F.expr("substring(value, length(substring_index(value, '\\r\\n\\r\\n', 1)) + 5)"), END, 1)
        ) + len(END))
        .withColumn("payload", F.when(F.col("whole"), body.substr(
            (F.col("header_bytes") + F.col("http_bytes") + 1).cast("int"),
            (F.col("length") - F.col("http_bytes")).cast("int"),
        )))
        .withColumn("payload_bytes", F.octet_length("payload").cast("long"))
        .withColumn("payload_digest", base32_sha1(F.col("payload")))
        .drop("payload", "value", "http_bytes")
    )


def on_chain(candidates):
    """file and at of the records reachable from the start of their file.

    Each round doubles the jumps: a reached record marks the one its jump leads to, and every jump is
    followed by its target's. The longest chain has as many records as a file has candidates. The joins are
    sorted ones: these tables are small on disk and large in memory, which a broadcast would not know.
    """
    jumps = stored(candidates.select("file", "at", "next", (F.col("at") == 0).alias("reached")), "warc-jumps")
    longest = jumps.groupBy("file").count().agg(F.max("count")).first()[0] or 0
    for _ in range(longest.bit_length()):
        target = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        marks = jumps.where("reached and next is not null").select("file", F.col("next").alias("at"),
                                                                 F.lit(True).alias("mark")).distinct()
        jumps = stored(
            jumps.join(target.hint("merge"), ["file", "next"], "left")
            .join(marks.hint("merge"), ["file", "at"], "left")
            .select("file", "at", F.col("then").alias("next"),
                    (F.col("reached") | F.coalesce("mark", F.lit(False))).alias("reached")),
            "warc-jumps",
        )
    return jumps.where("reached").select("file", "at")


RECORD = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "told_bytes", "told_digest"]


def read_archives(spark, path):
    """One row per record of the archives under path: what the header says, and the payload's size and digest.

    A payload that holds magics lies in several chunks; only files with such a record are read again, and the chunks
    of one record are put together.
    """
    found = stored(in_file(parsed(chunks(spark, path))).where("at >= 0"), "warc-chunks")
    candidates = found.where("header_bytes is not null and length is not null").withColumn(
        "next", F.col("at") + len(MAGIC) + F.col("header_bytes") + F.col("length") + len(END)
    )
    kept = stored(on_chain(candidates), "warc-kept")
    records = candidates.join(kept.hint("merge"), ["file", "at"])
    torn = records.where("not whole").select("file", "at", "next")
    if not torn.take(1):
        return records.select(*RECORD)
    pieces = in_file(chunks(spark, path).join(torn.select("file").distinct(), "file", "left_semi")).where("at >= 0")
    owned = Window.partitionBy("file").orderBy("at")
    starts = torn.select("file", "at", F.col("at").alias("owner"), "next")
    joined = (
        pieces.join(starts, ["file", "at"], "left")
        .withColumn("owner", F.last("owner", ignorenulls=True).over(owned))
        .withColumn("next", F.last("next", ignorenulls=True).over(owned))
        .where(F.col("at") < F.col("next"))
        .groupBy("file", F.col("owner").alias("at"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pieces"))
        .withColumn("value", F.array_join(F.col("pieces.value"), MAGIC))
        .select("file", "at", "value", F.octet_length("value").cast("long").alias("bytes"))
    )
    return records.where("whole").select(*RECORD).unionByName(parsed(joined).select(*RECORD))


def round_trip(pages, min_bytes=0):
    """Writes the pages as archives in the shared folder and reads them back: one row per page row.

    pages has page_id, url and html; other columns are ignored. A null html is an empty payload, a null url an empty
    target. Size and digest are those of the full payload: recomputed for responses, told by the header for revisits,
    which hold none. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archives(pages, path, min_bytes)
    revisit = F.col("record_type") == "revisit"
    return read_archives(spark, path).select(
        "page_id",
        F.when(revisit, F.col("told_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring("told_digest", 6, 32)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
