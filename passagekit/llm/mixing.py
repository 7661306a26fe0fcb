"""Mixing sources to target weights by hierarchical budgeting.

A budget of tokens goes down a tree of domain, language and source.  At each
node it is shared by weight among children, none of which gets more than its
whole subtree can give; what a child cannot use goes to its siblings, and
only what all siblings together cannot use is left to the ancestors' other
children.  Each leaf then reads its documents in seeded epochs: whole passes,
and a prefix of the last pass that ends at the budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ROW, cut, documents, keyed, running_before

BIG = "decimal(38,0)"
#: Documents of one block of a leaf's pass, about, in which running sums are taken.
BLOCK_ROWS = 256


def share(children: DataFrame, parent: list[str]) -> DataFrame:
    """``children`` (parent columns, name, weight, cap, budget of the parent) with ``got``: water-filling by weight under caps.

    In order of cap per weight a child is full while its cap is at most its
    part of what is left; the others share the rest by weight.  Whole tokens;
    the rounding rest of fewer tokens than children stays unspent.
    """
    w = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    order = w.orderBy((F.col("cap").cast("double") / F.col("weight")), "name").rowsBetween(W.unboundedPreceding, -1)
    before = children.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum("cap").over(order), F.lit(0))).alias("_left"),
        (F.sum("weight").over(w) - F.coalesce(F.sum("weight").over(order), F.lit(0))).alias("_weight"),
    )
    full = (F.col("cap").cast(BIG) * F.col("_weight").cast(BIG)) <= (F.col("weight").cast(BIG) * F.col("_left").cast(BIG))
    level = before.withColumn("_full", full)
    first = w.orderBy(F.col("_full"), (F.col("cap").cast("double") / F.col("weight")), "name")
    level = level.withColumn("_rest", F.first("_left").over(first)).withColumn("_share", F.first("_weight").over(first))
    part = F.expr(f"cast(cast(weight as {BIG}) * cast(_rest as {BIG}) div cast(_share as {BIG}) as bigint)")
    return level.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_left", "_weight", "_full", "_rest", "_share")


def leaf_budgets(leaves: DataFrame, path: list[str], weights: dict[str, Column], total: int, epochs: int) -> DataFrame:
    """Leaf budgets from ``leaves`` (path columns, tokens): one row a leaf with ``budget``."""
    node = leaves.withColumn("cap", F.col("tokens") * epochs)
    above = None
    for depth in range(1, len(path) + 1):
        keys, parent = path[:depth], path[: depth - 1]
        level = node.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        level = level.withColumn("weight", weights[path[depth - 1]].cast("long")).withColumn("name", F.col(path[depth - 1]))
        level = level.withColumn("budget", F.lit(total).cast("long")) if above is None else level.join(above, parent)
        above = share(level, parent).select(*keys, F.col("got").alias("budget"))
    return leaves.join(above, path)


def mix(
    docs: DataFrame, path: dict[str, Column], weights: dict[str, Column], total: float, epochs: int, seed: int, tokens: Column, id_col: str = "doc_id"
) -> DataFrame:
    """(doc_id, path columns, n_tokens, budget, copies, taken) of every row of ``docs``.

    ``total``: the mix's tokens as a part of the corpus's.  ``copies``: in how
    many epochs the document is taken, ``taken``: tokens taken of it in all.
    A pass takes documents in the order of md5(seed, epoch, id) while the
    tokens before them are below what the budget still needs, and of the last
    one only as many tokens; so a leaf's taken tokens are its budget.
    Null path parts are the name ``unknown``; texts without tokens weigh
    nothing and go with every pass that reaches them; rows that repeat are
    taken singly; a leaf without tokens gets no budget; no rows give no rows.
    The row numbers of ``keyed`` are passed on.
    """
    names, row = list(path), [c for c in (ROW,) if c in docs.columns]
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        *[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in path.items()],
        tokens.cast("long").alias("n_tokens"),
        *row,
    )
    rows = cut(rows, "mix-rows")
    leaves = rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    count, whole = rows.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    digits = max(1, math.ceil(math.log(max(1, count / BLOCK_ROWS), 16)))
    budgets = leaf_budgets(leaves, names, weights, int(whole * total), epochs).filter("tokens > 0")
    budgets = budgets.select(*names, "budget", F.expr("budget div tokens").alias("passes"), F.expr("budget % tokens").alias("need"))
    budgets = cut(budgets, "mix-leaves")
    key = F.coalesce(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("passes").cast("string"), F.col("doc_id").cast("string"))), F.lit(""))
    order = rows.join(budgets, names, "left").withColumn("key", key)
    order = order.withColumn("high", F.substring("key", 1, (digits + 1) // 2)).withColumn("block", F.substring("key", 1, digits))
    order = running_before(order, names, ["high", "block"], ["key", "n_tokens", *row], "n_tokens", "before")
    passes, left = F.coalesce(F.col("passes"), F.lit(0)), F.coalesce(F.col("need") - F.col("before"), F.lit(0))
    return order.select(
        "doc_id",
        *names,
        "n_tokens",
        F.coalesce("budget", F.lit(0)).cast("long").alias("budget"),
        (passes + (left > 0).cast("int")).cast("long").alias("copies"),
        (passes * F.col("n_tokens") + F.greatest(F.lit(0), F.least(left, F.col("n_tokens")))).cast("long").alias("taken"),
        *row,
    )


def token_prefix(text: Column, n: Column) -> Column:
    """``text`` up to its ``n``-th word, with the spaces before and between them."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.greatest(n, F.lit(0)).cast("int")), "")


#: Production parameters of the query: four fifths of the corpus's tokens, at most four epochs, and integer weights.
TOTAL, EPOCHS, SEED = 0.8, 4, 17
#: Sources belong to four domains by the remainder of their number; weights by name, others 1.
DOMAIN_WEIGHTS = {"0": 4, "1": 3, "2": 2, "3": 1}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 2}


def _weight(name: str, table: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in table.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Words between spaces, tabs and line ends; null: none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def source_mix(docs: DataFrame) -> DataFrame:
    """The mix of ``documents`` (lang, source, text) with the parameters above.

    The table names no domains: a source belongs to the domain of its number's
    remainder, a rule of this query and not of ``mix``, whose tree is its
    ``path`` and ``weights``.
    """
    number = F.regexp_extract(F.col("source"), "([0-9]+)$", 1)
    domain = F.when(number != "", (number.cast("long") % 4).cast("string"))
    return mix(
        docs,
        {"domain": domain, "lang": F.col("lang"), "source": F.col("source")},
        {"domain": _weight("domain", DOMAIN_WEIGHTS), "lang": _weight("lang", LANG_WEIGHTS), "source": F.lit(1)},
        TOTAL,
        EPOCHS,
        SEED,
        word_count(F.col("text")),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row in as many copies as epochs take it, the last one cut where the budget ends.

    A leaf's words are its budget.  ``n_chars``, where it is a column, is that
    of the text taken.  Repeated and null ids are rows like others; no rows
    give no rows.
    """
    rows = keyed(docs)
    plan = source_mix(rows).filter("copies > 0").select(ROW, *[F.col(c).alias("_" + c) for c in ("copies", "n_tokens", "taken")])
    both = rows.join(plan, ROW).withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
    left = F.col("_taken") - (F.col("_copies") - 1) * F.col("_n_tokens")
    short = (F.col("_copy") == F.col("_copies")) & (left < F.col("_n_tokens"))
    both = both.withColumn("text", F.when(short, token_prefix(F.col("text"), left)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(short, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(docs.columns)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix(documents(spark, sf_dir))
