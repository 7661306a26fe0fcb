"""Secret scan by corpus-wide ownership frequency, in DataFrame functions only.

Fixed patterns give the base findings.  Their values, and long mixed tokens
that no pattern names, are candidates: each is hashed, and the hash is counted
by distinct repository and owner over the whole corpus.  A value that many
owners or many repositories carry is a copied example; one that stays with
its owner and looks random is live, and is reported even where no pattern
names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, documents

#: The patterns of the base kinds, in their order; the group that holds the value; its least length.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
    "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "(AKIA[A-Z0-9]+)"
HEX = "([0-9a-f]+)"
TOKEN = "([A-Za-z0-9+/_-]+)"
#: Long runs: equal to the open patterns with their least length, since a run that fails is skipped whole.
ACCESS_LONG, HEX_LONG, TOKEN_LONG = "(AKIA[A-Z0-9]{16,})", "([0-9a-f]{24,})", "([A-Za-z0-9+/_-]{20,})"

KINDS = ("assign", "access", "hex", "live")
#: A value of this many owners, or of this many repositories of whatever owners, is a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 4
#: A live-looking value has at least so many distinct characters.
LIVE_CHARACTERS = 10

HIT = "array<struct<rank:int,pos:int,gap:int,length:int,value:string>>"


def _hits(text: Column, pattern: str, rank: int, group: int) -> Column:
    """All matches in order, each with the length of the text between it and the one before; a running sum places them."""
    none = F.array().cast(HIT)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    zipped = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    found = F.transform(
        zipped,
        lambda x, i: F.struct(F.lit(rank).alias("rank"), i.alias("pos"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("length"), x["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """(row, doc_id, repository, owner, hits) of every row; hits: all matches of the base patterns and of long tokens."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(repository, F.lit("")).alias("repository"),
        F.coalesce(owner, F.lit("")).alias("owner"),
    )
    text = F.col("text")
    hits = F.concat(
        _hits(text, ASSIGN, 0, 2),
        F.when(text.contains("AKIA"), _hits(text, ACCESS_LONG, 1, 1)).otherwise(F.array().cast(HIT)),
        _hits(text, HEX_LONG, 2, 1),
        _hits(text, TOKEN_LONG, 3, 1),
    )
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", hits.alias("hits"))


def placed(found: DataFrame) -> DataFrame:
    """(row, repository, owner, rank, start, end, value) of hits that count: base matches, and long tokens of letters and digits.

    Windows go over one text's hits of one kind.
    """
    hits = found.filter(F.size("hits") > 0).select("row", "repository", "owner", F.inline("hits"))
    so_far = W.partitionBy("row", "rank").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    hits = hits.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far).cast("int")).withColumn("start", F.col("end") - F.col("length"))
    least = F.when(F.col("rank") == 0, 6).when(F.col("rank") == 2, 24).otherwise(20)
    mixed = (F.col("rank") < 3) | (F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]"))
    return hits.filter((F.length("value") >= least) & mixed).select("row", "repository", "owner", "rank", "start", "end", "value")


def find_secrets(
    docs: DataFrame,
    repository: Column,
    owner: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
    example_repositories: int = EXAMPLE_REPOSITORIES,
) -> DataFrame:
    """(doc_id, findings) of every row of ``docs``, in order of start.

    findings: array of (start, end, kind, value, n_repositories, n_owners,
    status); status is ``example`` (``example_owners`` or more owners, or
    ``example_repositories`` or more repositories carry the value), ``live``
    (fewer, and it looks random) or ``weak``.  Kind ``live`` marks tokens that
    no base pattern covers and whose status is live.  Null texts count as
    empty; null repositories and owners are one of their own; rows that repeat
    are reported each; no rows give no rows.
    """
    found = cut(candidates(docs, id_col, text_col, repository, owner), "secrets")
    items = placed(found).withColumn("hash", F.sha2("value", 256))
    spread = items.groupBy("hash").agg(
        F.countDistinct("repository").alias("n_repositories"), F.countDistinct("owner").alias("n_owners")
    )
    looks = F.size(F.array_distinct(F.split("value", ""))) >= LIVE_CHARACTERS
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    status = F.when(copied, "example").when(looks, "live").otherwise("weak")
    # a token overlaps a base finding if one before it ends behind its start, or one after it starts before its end
    inside, base = W.partitionBy("row").orderBy("start", "rank"), F.col("rank") < 3
    reach = F.max(F.when(base, F.col("end"))).over(inside.rowsBetween(W.unboundedPreceding, -1))
    next_ = F.min(F.when(base, F.col("start"))).over(inside.rowsBetween(1, W.unboundedFollowing))
    covered = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(next_ < F.col("end"), F.lit(False))
    judged = items.join(spread, "hash").withColumn("status", status).withColumn("covered", covered).filter(base | ((F.col("status") == "live") & ~F.col("covered")))
    finding = F.struct(
        "start", "rank", "end", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind"), "value", "n_repositories", "n_owners", "status"
    )
    judged = judged.groupBy("row").agg(F.sort_array(F.collect_list(finding)).alias("findings"))
    kind = judged.schema["findings"].dataType
    return found.select("row", "doc_id").join(judged, "row", "left").select("doc_id", F.coalesce("findings", F.array().cast(kind)).alias("findings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are a source's languages, owners its sources."""
    found = find_secrets(documents(spark, sf_dir), F.concat_ws("/", "source", "lang"), F.col("source"))
    spans = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda field, value: F.size(F.filter("findings", lambda x: x[field] == value)).cast("long")
    return found.select(
        "doc_id",
        *[count("kind", k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(spans(F.filter("findings", lambda x: x["kind"] != "live")), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"),
        count("status", "live").alias("n_live"),
        count("status", "example").alias("n_example"),
    )
