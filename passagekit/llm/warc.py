"""WARC archives: records written by Spark's text writer, and read back by verified chains of boundaries.

Writing: one record a page.  The record separator of the format, two line
ends, is the writer's line separator, so archives come straight from rows.
Reading: the text reader divides archives at every version line, wherever a
split begins; each such place is a candidate whose header says where its
successor begins.  Candidates that follow one another are compacted to runs,
and pointer jumping from each archive's start keeps the runs that its chain
reaches: a version line inside a payload is never reached.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh, read, running_before

#: Fixed values of the format: a record's version line, and the end of headers and of records.
VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal digits."""
    digits = F.concat(digest, F.lit("0"))

    def letter(n: int) -> Column:
        at, shift = divmod(5 * n, 4)
        two = F.conv(F.substring(digits, at + 1, 2), 16, 10).cast("int")
        return F.substring(F.lit(ALPHABET), F.shiftright(two, 3 - shift).bitwiseAND(31) + 1, F.lit(1))

    return F.concat(*[letter(n) for n in range(32)])


def _urn(page_id: Column, digest: Column) -> Column:
    name = F.md5(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("none")), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """A record for every row of ``pages`` in archives below ``path``; the payload is the text in UTF-8 (null: empty).

    Of rows with equal payloads of at least ``least`` bytes, those with the
    smallest id are responses; the others are revisits without the payload,
    which name the response.  Rows that repeat both id and payload are alike.
    A null id is never the smallest, and rows that are all without an id are
    responses.  Spaces and control characters of an address are written as
    percent codes, so no header can hold a line end.  No rows: no records.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("key", F.sha2("html", 256))
    # repeated payloads alone: where they are few, Spark joins them without moving the payloads
    groups = rows.filter(F.octet_length("html") >= least).groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = cut(groups.filter("n > 1").select("key", "first"), "warc-firsts")
    records = rows.join(firsts, "key", "left").withColumn("digest", base32(F.sha1("html")))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.col("url")
    for plain, code in ((" ", "%20"), ("\t", "%09"), ("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(plain), F.lit(code))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    header = F.concat(
        F.lit(VERSION), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}\r\n"),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        F.when(revisit, F.concat(line("WARC-Refers-To", _urn(F.col("first"), F.col("digest"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.coalesce(line("X-Page-Id", F.col("page_id").cast("string")), F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END), F.col("block"),
    )
    records.withColumn("block", block).select(header.alias("value")).write.option("lineSep", END).text(path)


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): what stands between version lines, in order of ``seq`` in each split."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return spark.read.option("lineSep", VERSION).text(path).select(*where, F.monotonically_increasing_id().alias("seq"), "value")


#: What a header and a payload say, beside where the header ends.
FIELDS = ["record_type", "record_id", "refers_to_id", "target_uri", "stated_digest", "page_id", "payload_bytes", "payload_digest"]


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` with the bytes of ``value`` and of its header, its stated length, whether it has all of its block, and FIELDS.

    Positions are in bytes: a payload need not be text.
    """
    size, head = F.octet_length("value"), F.substring_index("value", END, 1)
    rows = rows.withColumn("size", size.cast("long")).withColumn("head", F.when(F.octet_length(head) < size, head))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    rows = rows.withColumn("head_size", F.octet_length("head").cast("long")).withColumn("length", F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)content-length:[ \\t]*([0-9]+)', 1), '') as long)"))
    rows = rows.withColumn("whole", F.coalesce(F.col("size") >= F.col("head_size") + 4 + F.col("length"), F.lit(False)))
    block = F.substring(F.col("value").cast("binary"), (F.col("head_size") + 5).cast("int"), F.col("length").cast("int"))
    rows = rows.withColumn("block_", F.when(F.col("whole"), block))
    http = F.when(F.coalesce(field("content-type"), F.lit("")).startswith("application/http"), F.octet_length(F.substring_index(F.col("block_").cast("string"), END, 1)) + 4).otherwise(0)
    rows = rows.withColumn("payload", F.substring("block_", http + 1, F.octet_length("block_")))
    found = {
        "record_type": field("warc-type"), "record_id": field("warc-record-id"), "refers_to_id": field("warc-refers-to"), "target_uri": field("warc-target-uri"),
        "stated_digest": F.replace(field("warc-payload-digest"), F.lit("sha1:"), F.lit("")), "page_id": F.expr(r"try_cast(nullif(regexp_extract(head, '(?i)(?:^|\\r\\n)x-page-id:[ \\t]*([^\\r\\n]*)', 1), '') as long)"),
        "payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32(F.sha1("payload")),
    }
    return rows.withColumns(found).drop("head", "block_")


def reached(candidates: DataFrame) -> DataFrame:
    """Rows of ``candidates`` (file, block, offset, next, ...) that their file's chain from offset 0 reaches.

    next: where the successor begins, beyond the row's own offset, or null.
    Neighbours in a block that follow one another are one run; a run begins
    anew wherever some other pointer lands, so pointers between runs always
    land on beginnings, and only runs are jumped between: after round k every
    run within 2**k of the start is marked.
    """
    along = W.partitionBy("file", "block").orderBy("offset")
    rows = candidates.withColumn("_after", F.lead("offset").over(along)).withColumn("_before", F.lag("next").over(along))
    rows = cut(rows, "warc-pointers")
    jumps = rows.filter(F.col("next").isNotNull() & ~F.col("next").eqNullSafe(F.col("_after"))).select("file", F.col("next").alias("offset"), F.lit(True).alias("_landed")).distinct()
    begins = F.col("_landed").isNotNull() | (F.col("offset") == 0) | ~F.coalesce(F.col("_before") == F.col("offset"), F.lit(False))
    rows = rows.join(jumps, ["file", "offset"], "left").withColumn("_run", F.last(F.when(begins, F.col("offset")), ignorenulls=True).over(along))
    rows = cut(rows.drop("_after", "_before", "_landed"), "warc-runs")
    runs = cut(rows.groupBy("file", F.col("_run").alias("run")).agg(F.max_by("next", "offset").alias("next")), "warc-runs")
    pointers = runs.join(runs.select("file", F.col("run").alias("next")), ["file", "next"]).select("file", "run", "next")
    marked, known = runs.filter("run = 0").select("file", "run"), -1
    while True:
        pointers, marked = cut(pointers, "warc-jumps"), cut(marked, "warc-marked")
        before, known = known, marked.count()
        if known == before:
            return rows.join(marked.withColumnRenamed("run", "_run"), ["file", "_run"], "left_semi").drop("_run")
        landed = pointers.join(marked, ["file", "run"], "left_semi").select("file", F.col("next").alias("run"))
        marked = marked.unionByName(landed).distinct()
        further = pointers.select("file", F.col("run").alias("next"), F.col("next").alias("_next"))
        pointers = pointers.join(further, ["file", "next"]).select("file", "run", F.col("_next").alias("next"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, next, whole, and FIELDS) of every record of the archives below ``path``.

    A record is what the chain of lengths from the archive's start reaches.
    A chain that breaks, by a damaged length, ends there; a last record cut
    short is not ``whole`` and has no payload fields.  Payloads that hold
    version lines are put together again from their pieces, found by owner in
    a second scan.  Archives may be plain, which are read in splits, or
    gzipped, one task each; no archives' records: no rows.
    """
    narrow = ["file", "block", "seq", "size", "head_size", "length", "whole", *FIELDS]
    survey = cut(_parsed(_fragments(spark, path)).select(*narrow), "warc-survey")
    placed = running_before(survey.withColumn("span", F.col("size") + len(VERSION)), ["file"], ["block"], ["seq"], "span", "start")
    placed = placed.withColumn("offset", F.col("start") - len(VERSION)).filter("offset >= 0")
    # a record: version line, header, two line ends, block, two line ends
    candidates = cut(placed.withColumn("next", F.col("start") + F.col("head_size") + 4 + F.col("length") + 4).drop("span", "start"), "warc-candidates")
    found = cut(reached(candidates), "warc-reached")
    kept = ["file", "offset", "next", "whole", *FIELDS]
    open_ = found.filter(~F.col("whole") & F.col("next").isNotNull())
    if open_.isEmpty():
        return found.select(*kept)
    owners = candidates.join(found.select("file", "offset", F.col("offset").alias("_own")), ["file", "offset"], "left")
    blocks = owners.groupBy("file", "block").agg(F.max("_own").alias("_most"))
    blocks = blocks.withColumn("_carried", F.max("_most").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))).drop("_most")
    inside = F.max("_own").over(W.partitionBy("file", "block").orderBy("offset").rowsBetween(W.unboundedPreceding, 0))
    owners = owners.withColumn("_inside", inside).join(blocks, ["file", "block"]).withColumn("owner", F.coalesce("_inside", "_carried"))
    pieces = owners.select("file", "block", "seq", "offset", "owner", F.col("size").alias("_size")).join(open_.select("file", F.col("offset").alias("owner"), F.col("next").alias("_next")), ["file", "owner"])
    pieces = cut(pieces.filter(F.col("offset") < F.col("_next")), "warc-pieces")
    same = F.when(F.octet_length("value") == F.col("_size"), F.col("value")).otherwise(F.raise_error(F.lit("an archive changed between two scans")))
    texts = _fragments(spark, path).join(pieces, ["file", "block", "seq"]).select("file", "owner", "_next", "offset", same.alias("value"))
    texts = texts.groupBy("file", "owner", "_next").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("all"))
    texts = texts.select("file", F.col("owner").alias("offset"), F.col("_next").alias("next"), F.array_join("all.value", VERSION).alias("value"))
    joined = cut(_parsed(texts).select(*kept), "warc-joined")
    return found.filter(F.col("whole") | F.col("next").isNull()).select(*kept).unionByName(joined)


def pages_back(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of ``records``: a revisit has the payload of the response it names."""
    wanted = records.filter("record_type = 'revisit'").select(F.col("refers_to_id").alias("_id")).distinct()
    first = records.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest"))
    first = first.join(wanted, "_id", "left_semi").dropDuplicates(["_id"])
    again = F.col("record_type") == "revisit"
    rows = records.join(first, F.col("refers_to_id") == F.col("_id"), "left")
    return rows.select(
        "page_id", F.when(again, F.col("_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", F.when(again, F.col("_page")).alias("refers_to"),
    )


def op11_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh(spark, "warc")
    write_archives(read(spark, sf_dir, "pages"), path)
    return pages_back(read_records(spark, path))
