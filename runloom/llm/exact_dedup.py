"""Exact duplicates by deterministic block naming.

A text without its white space is cut into blocks of a fixed size. Equal blocks
get equal integer names, different blocks different ones; then adjacent pairs of
names are named in the same way, until each document has one name. Documents are
equal exactly if they have the same number of blocks and the same last name:
names stand for contents, so the identity has no collisions.

A name is a pair of integers: a 64-bit hash that deals the keys of a level into
small bins, and the key's rank among the sorted distinct keys of its bin. It
follows from the data alone, not from partitions or task order, so a lost task
computes it again. Bins with one distinct key, nearly all, give rank 0 at sight:
the smallest and the largest key of a bin, which partial aggregates bring down
to one pair for each task and bin, show which bins need sorting. So the text
moves once, however many copies a block has, and no group is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runloom.llm.stage import discard, documents, staged

BLOCK = 2048
# White space of the contract: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _named(rows: DataFrame, keep: list[str], key: str, bin_of=F.xxhash64) -> DataFrame:
    """Columns ``keep`` and the name (h, r) of ``key``."""
    rows = rows.withColumn("h", bin_of(key))
    crowded = rows.groupBy("h").agg(F.min(key).alias("low"), F.max(key).alias("high")).filter("low < high")
    crowded = staged(crowded.select("h"), "crowded", free=True)
    if crowded.isEmpty():
        return rows.select(*keep, "h", F.lit(0).alias("r"))
    distinct = rows.join(crowded, "h", "left_semi").select("h", key).distinct()
    ranks = staged(distinct.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(key)) - 1), "ranks")
    return rows.join(ranks, ["h", key], "left").select(*keep, "h", F.coalesce("r", F.lit(0)).alias("r"))


def identities(docs: DataFrame, size: int = BLOCK, bin_of=F.xxhash64) -> DataFrame:
    """(doc_id, n_chars, text_sha256, blocks, h, r): what documents of the same content agree in but for doc_id and n_chars.

    The digest only tells the texts of one id apart on their way; texts are equal
    when their names are.
    """
    content = normalised("text")
    n = F.greatest(F.lit(1), F.ceil(F.length(content) / size)).cast("int")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring("content", i * size + 1, F.lit(size))))
    own = ["doc_id", "n_chars", "text_sha256", "blocks"]
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), n.alias("blocks"), content.alias("content"))
    rows = rows.withColumn("text_sha256", F.sha2("content", 256)).select(*own, at.alias("i", "key"))
    keep = [*own, "i"]
    level = staged(_named(rows, keep, "key", bin_of), "names")
    done = [level.filter("blocks = 1")]
    longest = level.agg(F.max("blocks")).first()[0] or 1
    width = 1
    while width < longest:
        width *= 2
        left = F.col("i") % 2 == 0
        pairs = level.filter(F.col("blocks") > width // 2).groupBy(*own, F.floor(F.col("i") / 2).cast("int").alias("i")).agg(
            *[F.max(F.when(side, F.col(c))).alias(f"{s}{c}") for s, side in (("l", left), ("r", ~left)) for c in ("h", "r")]
        )
        pairs = pairs.select(*keep, F.struct("lh", "lr", F.coalesce("rh", F.lit(0)).alias("rh"), F.coalesce("rr", F.lit(-1)).alias("rr")).alias("key"))
        level = staged(_named(pairs, keep, "key", bin_of), "names")
        done.append(level.filter((F.col("blocks") > width // 2) & (F.col("blocks") <= width)))
    roots = done[0]
    for rest in done[1:]:
        roots = roots.union(rest)
    return roots.drop("i")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; null counts as
    empty, and empty and blank texts equal one another. Of equal texts the one
    with the most code points stays, then the one with the smallest id.
    ``text_sha256`` is that of the text without white space, in UTF-8. A row that
    repeats an id with the same text counts once and gives one row; rows that
    give an id several texts count as so many documents. Rows without an id are
    left out, and an empty table gives an empty one.
    """
    same = ["blocks", "h", "r"]
    roots = staged(identities(documents(docs, id_col, text_col), size).distinct(), "roots")
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), "doc_id"))
    groups = staged(roots.groupBy(*same).agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    return roots.join(groups, same).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        ((F.col("doc_id") == F.col("first.doc_id")) & (F.col("n_chars") == -F.col("first.n"))).alias("kept"), "text_sha256",
    )
