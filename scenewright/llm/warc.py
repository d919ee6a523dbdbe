"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Archives are WARC/1.0 files, gzipped as a whole when we write them. They are written
and read through Spark's own readers and writers, so any store that Spark reaches will
do; an archive that isn't compressed is split over tasks.

Reading: the file is cut at every place where the magic ``WARC/1.0 CRLF`` stands, also
where a payload merely contains it. Each piece is a candidate record: its offset is a
prefix sum of the piece lengths (summed per split first, then over the few splits of a
file), and its header tells the offset of its successor. From these candidate edges,
pointer jumping (the jump table is composed with itself each round) marks what can be
reached from offset 0 of the file. Candidates that are not reached lie inside payloads
and are joined to the record that holds them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, salt, with_salts

MAGIC = "WARC/1.0\r\n"
#: Payloads shorter than this are always written in full.
MIN_REVISIT_BYTES = 1000
#: Records in one archive file at most.
RECORDS_PER_FILE = 5_000
SALTS = 16
#: The profile of revisit records: an equal payload (fixed value of the format).
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: The HTTP head that stands before each payload.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def archive_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder."""
    checkpointed(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"


def plan_records(pages: DataFrame, id_col: str, url_col: str, body_col: str, min_bytes: int) -> DataFrame:
    """id, url, payload, bytes, digest and, for revisits, the id that is referred to."""
    body = F.coalesce(F.col(body_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        body.alias("payload"),
        F.octet_length(body).alias("bytes"),
        F.sha1(F.encode(body, "UTF-8")).alias("digest"),
    ).withColumn("_salt", salt("id", salts=SALTS))
    best = (
        rows.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes")
        .agg(F.count("*").alias("n"), F.max("id").alias("refers_to"))
        .filter("n > 1")
        .drop("n")
    )
    rows = rows.join(with_salts(best, SALTS), ["digest", "bytes", "_salt"], "left")
    return rows.withColumn("refers_to", F.when(F.col("id").eqNullSafe(F.col("refers_to")), None).otherwise(F.col("refers_to")))


def one_line(c: Column) -> Column:
    """A header value without line ends."""
    return F.regexp_replace(c, r"[\r\n]+", " ")


def record_urn(c: Column) -> Column:
    return F.concat(F.lit("<urn:pages:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """One WARC record per row of ``pages`` into archives under ``path``.

    Null payloads count as empty, null urls as "". Of payloads that are equal and of
    ``min_revisit_bytes`` at least, that with the largest id is a ``response``; the
    others are ``revisit`` records that refer to it and carry no payload. Rows
    repeated with one id are responses each where that id is the largest. A null id is
    written as an empty one.
    """
    rows = plan_records(pages, id_col, url_col, body_col, min_revisit_bytes)
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP_HEAD), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    header = F.concat(
        F.lit(MAGIC + "WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: "),
        record_urn(F.col("id")),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Target-URI: "),
        one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), record_urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"),
    )
    # The writer ends each row with "\n": the last character of the record's end.
    records = rows.select(F.concat(header, block, F.lit("\r\n\r")).alias("value"))
    records.write.option("lineSep", "\n").option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file (a hash of its path), split, seq, piece: what lies between one magic and the next."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.xxhash64(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("piece"),
    )


def with_offsets(cut: DataFrame) -> DataFrame:
    """Adds the offset of each piece's magic: the lengths before it in its split, and the splits before that.

    What stands before a file's first magic gets offset -len(MAGIC).
    """
    at = cut.groupBy("file", "split").agg(F.sum("len").alias("sum"))
    at = at.withColumn("base", F.sum("sum").over(W.partitionBy("file").orderBy("split")) - F.col("sum")).drop("sum")
    run = F.sum("len").over(W.partitionBy("file", "split").orderBy("seq")) - F.col("len")
    cut = cut.withColumn("run", run).join(at, ["file", "split"])
    return cut.withColumn("offset", F.col("base") + F.col("run") - F.lit(len(MAGIC))).drop("base", "run", "len")


def field(header: Column, name: str) -> Column:
    return F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1)


def head_of(c: Column) -> Column:
    """The bytes before the first blank line; null without one."""
    head = F.substring_index(c, "\r\n\r\n", 1)
    return F.when(F.octet_length(head) < F.octet_length(c), head)


def payload_of(data: Column) -> Column:
    """What follows the HTTP head of a block; the block itself if it has none."""
    head = head_of(data.cast("string"))
    return F.when(head.isNull(), data).otherwise(F.substring(data, F.octet_length(head) + 5, F.octet_length(data)))


def candidates(cut: DataFrame, project: dict) -> DataFrame:
    """Pieces as candidate records: header, block start and size, and, if the piece holds the whole record, ``project`` of its payload."""
    out = cut.withColumn("header", head_of(F.col("piece"))).withColumn("len", F.octet_length("piece").cast("long") + F.lit(len(MAGIC)))
    size = field(F.col("header"), "Content-Length")
    out = out.withColumn("size", F.when(size.rlike(r"^\d{1,18}$"), size.cast("long"))).withColumn("block", F.octet_length("header") + F.lit(4))
    whole = F.octet_length("piece") >= F.col("block") + F.col("size")
    data = F.substring(F.col("piece").cast("binary"), F.col("block") + 1, F.col("size").cast("int"))
    out = out.withColumn("data", F.when(whole, data))
    return out.select("file", "split", "seq", "len", "header", "block", "size", F.col("data").isNotNull().alias("whole"), *[f(payload_of(F.col("data"))).alias(k) for k, f in project.items()])


def reachable(edges: DataFrame) -> DataFrame:
    """Candidates (file, offset) that pointer jumping reaches from the start of each file.

    ``edges``: file, offset, next. Each round the jump table is composed with itself and
    applied to what is reached already, so a file of n records takes log2(n) rounds.
    """
    jump = checkpointed(edges.join(edges.select("file", F.col("offset").alias("next")), ["file", "next"], "left_semi").select("file", "offset", "next"))
    reach = edges.filter("offset = 0").select("file", "offset").distinct()
    while True:
        step = reach.join(jump, ["file", "offset"]).select("file", F.col("next").alias("offset"))
        reach = checkpointed(reach.unionByName(step).distinct())
        then = jump.select("file", F.col("offset").alias("next"), F.col("next").alias("then"))
        jump = checkpointed(jump.join(then, ["file", "next"]).select("file", "offset", F.col("then").alias("next")))
        if jump.isEmpty():
            return reach


def read_warc(spark: SparkSession, path: str, project: dict | None = None) -> DataFrame:
    """Records of the archives under ``path``: ``file, offset, header`` and the columns of ``project``.

    ``project`` maps names to functions of the payload column (what follows the HTTP
    head in the record's block); it is applied where the record is scanned, so that
    payloads need not be shuffled. By default the payload itself is returned. A record
    whose header is damaged or whose chain leads nowhere ends the file there. Magic
    inside payloads is given back as payload. Archives without records give no rows.
    """
    project = project or {"payload": lambda p: p}
    cut = checkpointed(with_offsets(candidates(pieces(spark, path), project)).filter("offset >= 0"))
    edges = cut.filter("size is not null").select("file", "offset", (F.col("offset") + F.lit(len(MAGIC) + 4) + F.col("block") + F.col("size")).alias("next"))
    real = reachable(edges).withColumn("real", F.lit(True))
    rows = checkpointed(cut.join(real, ["file", "offset"], "left"))
    held = rows.filter("real and whole").select("file", "offset", "header", *project)
    if rows.filter("real and not whole").isEmpty():
        return held
    # Pieces that are not reached belong to the record before them. They are read again, and
    # met by their offsets, which the bytes decide; row numbers of two scans need not agree.
    owner = F.last(F.when(F.col("real"), F.col("offset")), ignorenulls=True).over(W.partitionBy("file").orderBy("offset"))
    parts = rows.select("file", "offset", "real", "whole", owner.alias("owner")).filter("real is null or not whole").filter("owner is not null")
    magic = F.encode(F.lit(MAGIC), "UTF-8")
    body = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["piece"].cast("binary"), lambda a, p: F.concat(a, magic, p["piece"].cast("binary")))
    again = pieces(spark, path).join(parts.select("file").distinct(), "file", "left_semi")
    again = with_offsets(again.withColumn("len", F.octet_length("piece").cast("long") + F.lit(len(MAGIC))))
    joined = (
        again.join(parts.select("file", "offset", "owner"), ["file", "offset"])
        .groupBy("file", "owner")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "piece"))).alias("parts"))
        .select("file", F.col("owner").alias("offset"), body.alias("body"))
        .join(rows.filter("real and not whole").select("file", "offset", "header", "block", "size"), ["file", "offset"])
        .withColumn("data", F.substring(F.col("body"), F.col("block") + 1, F.col("size").cast("int")))
    )
    return held.unionByName(joined.select("file", "offset", "header", *[f(payload_of(F.col("data"))).alias(k) for k, f in project.items()]))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes the archives, reads them back and resolves revisits.

    ``id, payload_bytes, payload_digest, record_type, refers_to``; sizes and digests are
    those of the payload that was read, for revisits of the response they refer to.
    """
    spark = pages.sparkSession
    path = archive_dir(spark)
    write_warc(pages, path, id_col, url_col, body_col, min_revisit_bytes)

    def id_of(name: str) -> Column:
        v = F.regexp_extract(field(F.col("header"), name), r"^<urn:pages:(-?\d+)>$", 1)
        return F.when(v != "", v.cast("long"))

    measure = {"bytes": lambda p: F.octet_length(p).cast("long"), "digest": F.sha1}
    got = read_warc(spark, path, measure).select(
        id_of("WARC-Record-ID").alias("id"),
        field(F.col("header"), "WARC-Type").alias("record_type"),
        id_of("WARC-Refers-To").alias("refers_to"),
        "bytes",
        "digest",
    )
    got = checkpointed(got.withColumn("_salt", salt("id", salts=SALTS)))
    full = got.filter("record_type = 'response' and id is not null").dropDuplicates(["id"])
    full = full.select(F.col("id").alias("refers_to"), F.col("bytes").alias("full_bytes"), F.col("digest").alias("full_digest"))
    out = got.join(with_salts(full, SALTS), ["refers_to", "_salt"], "left")
    return out.select(
        "id",
        F.coalesce("full_bytes", "bytes").alias("payload_bytes"),
        F.coalesce("full_digest", "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
