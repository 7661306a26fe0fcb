"""Personal data by bootstrapped contextual extraction.

Fixed patterns find base entities, the seeds.  The words around a seed induce
lexical patterns with a slot for the entity: words lose their case and
punctuation, numbers become their shape, and one word may be a wild card.
Identifier-like tokens in the same slots are candidates.  Spark scores the
graph of patterns and instances in rounds: a pattern is as good as the
instances it holds, an instance as the patterns that hold it.  Candidates held
by patterns of high confidence are reported beside the base entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, documents

#: The kinds in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: An address is `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+`: what may stand before the sign, and what must follow it.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: An ip is `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`: four numbers in a run of digits and single points.
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Rounds of scoring; instances a pattern needs; the smoothing of its confidence; the confidence at which it counts.
ROUNDS, LEAST_INSTANCES, SMOOTHING, CONFIDENT = 3, 4, 1.0, 0.75
#: A candidate is a token of so many characters with a digit or an at sign in it.
TOKEN_CHARACTERS = (4, 256)
TOKEN, DIGIT, SIGN = re.compile(r"\S+"), re.compile("[0-9]"), re.compile("[0-9@]")
TRIM = ".,;:!?()[]{}<>\"'|"
#: Characters on either side in which a pattern's words are looked for.
REACH = 80


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_entities(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and then start."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:  # from the sign backwards and forwards: linear in texts of any shape
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if DIGIT.search(text):
        for m in NUMBERS.finditer(text):  # a run is read once, four numbers at a time
            if "." in m[0]:
                at, parts = m.start(), m[0].split(".")
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    end = at + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                        found.append((1, at, end))
                    at = end + 1
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def _slot(word: str) -> str:
    """A word of a pattern: without case and punctuation, digits as their shape."""
    return DIGIT.sub("0", word.strip(TRIM).lower()) or word


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: up to two words before and one behind, each form with and without a wild card."""
    before = [_slot(w) for w in text[max(0, start - REACH) : start].split()[-2:]]
    after = [_slot(w) for w in text[end : end + REACH].split()[:1]]
    two, one = (["^", "^", *before])[-2:]
    behind = (after or ["$"])[0]
    return [f"{two} {one} _", f"{one} _ {behind}", f"{two} * _ {behind}", f"* {one} _ {behind}", f"{two} {one} _ {behind}"]


def mentions(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base entities, and (kind or -1, start, end, value, patterns) of every base entity and candidate token."""
    base = base_entities(text)
    if not base and not SIGN.search(text):
        return base, []
    out = [(k, s, e, text[s:e], patterns(text, s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    at, reach, (least, most) = 0, 0, TOKEN_CHARACTERS
    for m in TOKEN.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start() or not SIGN.search(m[0]):  # a token that a base entity touches is no candidate
            continue
        token = m[0].lstrip(TRIM)
        start = m.end() - len(token)
        token = token.rstrip(TRIM)
        if least <= len(token) <= most and SIGN.search(token):
            out.append((-1, start, start + len(token), token, patterns(text, start, start + len(token))))
    return base, out


MENTION = "array<struct<kind:int,start:int,end:int,value:string,patterns:array<string>>>"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in batches:
        found = []
        for text in batch.column(1):
            rows = mentions(text.as_py() or "")[1]
            found.append([dict(zip(("kind", "start", "end", "value", "patterns"), r, strict=True)) for r in rows])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(item))], ["doc_id", "mentions"])


def pattern_scores(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (value, kind, score) from distinct edges (pattern, value, kind or -1).

    Seeds score 1 in their own kind.  A pattern's confidence in a kind is the
    sum of its instances' scores over their number plus a smoothing; another
    instance scores the chance that one of its confident patterns is right.
    Both are sums over edges, so popular patterns only cost partial sums;
    patterns of too few instances leave the graph before the first round, and
    joins shuffle both sides, since all of them grow with the corpus.
    """
    sizes = edges.groupBy("pattern").agg(F.count_distinct("value").alias("n"), F.count_if(F.col("kind") >= 0).alias("seeds"))
    sizes = cut(sizes.filter((F.col("n") >= LEAST_INSTANCES) & (F.col("seeds") > 0)).select("pattern", "n"), "pii-sizes")
    seeds = edges.filter("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    edges = cut(edges.join(sizes.hint("merge"), "pattern").select("pattern", "value", "kind", "n"), "pii-edges")
    known = edges.select("pattern", "value", "n").distinct()
    # values that are seeds somewhere keep their score; only the others are inferred
    open_ = known.join(seeds.select("value").distinct().hint("merge"), "value", "left_anti")
    seeds = seeds.join(known.select("value").distinct().hint("merge"), "value", "left_semi")
    scores, confidence = seeds, None
    for _ in range(rounds):
        held = known.join(scores.hint("merge"), "value").groupBy("pattern", "n", "kind").agg(F.sum("score").alias("s"))
        confidence = held.select("pattern", "kind", (F.col("s") / (F.col("n") + SMOOTHING)).alias("confidence"))
        confidence = cut(confidence.filter(F.col("confidence") >= CONFIDENT), "pii-patterns")
        grown = open_.join(confidence.hint("merge"), "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1.000001 - F.col("confidence"))))).alias("score"))
        scores = cut(seeds.unionByName(grown), "pii-instances")
    return confidence, scores


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, entities) of every row: arrays of (kind, start, end), by kind and then start.

    base: the fixed patterns' findings; entities: these and what the method
    adds, which never overlaps a base one: a candidate in the slot of a
    confident pattern, of that pattern's kind (the more confident of several,
    the earlier kind of equals).  Offsets are code points, ends exclusive.
    Null texts count as empty; texts are read whole, in time linear in their
    length; rows that repeat are reported each; null ids are rows like others;
    no rows give no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_mentions, f"doc_id long, mentions {MENTION}").withColumn("row", F.monotonically_increasing_id())
    found = cut(found, "pii-mentions")
    single = found.select("row", F.inline("mentions")).withColumn("pattern", F.explode("patterns")).drop("patterns")
    confidence, _ = pattern_scores(single.select("pattern", "value", "kind").distinct(), rounds)
    sure = F.max(F.struct("confidence", (-F.col("kind")).alias("kind")))
    met = single.filter("kind < 0").drop("kind").join(confidence.hint("merge"), "pattern")
    new = met.groupBy("row", "start", "end").agg(sure.alias("best")).select("row", (-F.col("best.kind")).alias("kind"), "start", "end")
    new = new.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    span = "array<struct<kind:int,start:int,end:int>>"
    base = F.transform(F.filter("mentions", lambda m: m["kind"] >= 0), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
    both = found.select("row", "doc_id", base.alias("base")).join(new.hint("merge"), "row", "left")
    return both.select("doc_id", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", F.coalesce("new", F.array().cast(span)))).alias("entities"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(documents(spark, sf_dir))
    kind = F.array(*map(F.lit, KINDS))
    joined = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("entities")).alias("spans"),
    )
