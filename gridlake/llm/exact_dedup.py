"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every normalised text is cut into fixed-size blocks of bytes. The distinct blocks are sorted by their bytes within hash
buckets and their rank there, with the bucket, is the block's integer name: equal names mean equal blocks.
Then adjacent pairs of names are named the same way, level by level, until each document
holds one name. Names cannot collide, because a rank over distinct values decides them; a digest only carries a block's name back
to its places. That the digests tell all blocks apart is checked, and if they did not, their contents would decide.

Plan: distinct blocks are shuffled twice, by digest (after map-side combining, so a block that a third of the corpus shares
costs one row a task) and by bucket, to be sorted; everything later moves rows of a few integers. Each level halves the rows; the number of levels
is the logarithm of the longest text's block count. Names go back to places, and groups to documents, by joins of which adaptive
execution can split a hot key, since on either side an exchange stands just before the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, grouped, lower_ascii, staged

BLOCK_BYTES = 4096
#: Names are rank * BUCKETS + bucket. A bucket's distinct values are ranked in one task.
BUCKETS = 1 << 20


def _digest(block: Column) -> tuple[Column, Column]:
    return F.xxhash64(block), F.xxhash64(F.lit(7), block)


def _named(values: DataFrame, by: list[str], bucket: Column, name: str) -> DataFrame:
    """Distinct rows with an integer name: rank within the bucket, then the bucket."""
    rank = F.dense_rank().over(W.partitionBy("_bucket").orderBy(*by))
    return values.withColumn("_bucket", bucket).withColumn(name, rank.cast("long") * BUCKETS + F.col("_bucket")).drop("_bucket")


def block_names(blocks: DataFrame) -> DataFrame:
    """Blocks as ``h1, h2, block`` to their distinct ones with ``name``, the rank by their bytes."""
    return _named(blocks.select("h1", "h2", "block").distinct(), ["block"], F.pmod("h1", F.lit(BUCKETS)), "name")


def name_documents(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` rows as ``row, doc_id, text_sha256, level, name``; equal (level, name) means equal normalised texts.

    A null text is the empty string; the empty text is one empty block.
    """
    norm = lower_ascii(F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), norm.alias("t")).select(
        "row", "doc_id", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), F.col("t").cast("binary").alias("b")
    )

    def cut(rows: DataFrame) -> DataFrame:
        count = F.greatest(F.ceil(F.octet_length("b") / F.lit(block_bytes)).cast("int"), F.lit(1))
        return rows.withColumn("blocks", F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(F.col("b"), i * block_bytes + 1, F.lit(block_bytes))))

    def places_of(rows: DataFrame) -> DataFrame:
        digests = F.transform("blocks", lambda x: F.struct(_digest(x)[0].alias("h1"), _digest(x)[1].alias("h2")))
        return cut(rows).select("row", "doc_id", "text_sha256", digests.alias("digests"))

    # Rows are numbered here once; blocks carry no number, so that evaluating the texts again cannot mix rows up.
    marked = checkpointed(places_of(base))
    # Outer, though no text is without a block: else the planner evaluates all blocks once more, in a filter of texts that have some.
    contents = cut(base).select(F.explode_outer("blocks").alias("block")).select(*(c.alias(n) for n, c in zip(("h1", "h2"), _digest(F.col("block")))), "block")
    names = checkpointed(block_names(contents).select("h1", "h2", "name"))
    several = checkpointed(names.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2"))
    if several.isEmpty():
        places = marked.select("row", F.posexplode("digests").alias("pos", "d")).select("row", "pos", F.col("d.h1").alias("h1"), F.col("d.h2").alias("h2"))
        level = places.join(names, ["h1", "h2"]).select("row", "pos", "name")
    else:  # one digest for several contents: here the contents decide, and numbers and texts come from one table
        base = staged(base, "numbered")
        marked = checkpointed(places_of(base))
        whole = cut(base).select("row", F.posexplode_outer("blocks").alias("pos", "block")).select(
            "row", "pos", *(c.alias(n) for n, c in zip(("h1", "h2"), _digest(F.col("block")))), "block"
        )
        level = whole.join(block_names(whole), ["h1", "h2", "block"]).select("row", "pos", "name")

    most = marked.agg(F.max(F.size("digests"))).first()[0] or 1
    done, depth = [], 0
    sizes = marked.select("row", F.size("digests").alias("n"))
    while True:
        if most == 1:
            done.append(level.select("row", F.lit(depth).alias("level"), "name"))
            break
        # Documents of one block are named; the others go on with pairs of names.
        if depth == 0:
            level = checkpointed(level.join(sizes, "row"))
        done.append(level.filter("n = 1").select("row", F.lit(depth).alias("level"), "name"))
        pairs = (
            level.filter("n > 1")
            .groupBy("row", F.shiftright("pos", 1).alias("pos"), ((F.col("n") + 1) / 2).cast("int").alias("n"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
            )
        )
        pairs = checkpointed(pairs)
        named = _named(pairs.select("left", "right").distinct(), ["left", "right"], F.pmod(F.xxhash64("left", "right"), F.lit(BUCKETS)), "name")
        level = checkpointed(pairs.join(named, ["left", "right"]).select("row", "pos", "n", "name"))
        most, depth = (most + 1) // 2, depth + 1
        if most == 1:
            done.append(level.select("row", F.lit(depth).alias("level"), "name"))
            break
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return marked.select("row", "doc_id", "text_sha256").join(every, "row")


def exact_dedup(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document, dropped ones too: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of a group the row with the largest ``doc_id`` stays
    (null ids come first); of repeated rows with that id one stays. A null text counts as empty. Other columns of ``docs`` do not matter.
    """
    named = name_documents(docs.select("doc_id", F.col(text).alias("text")), "text", block_bytes)
    best = F.max(F.struct("doc_id", "row"))
    groups = grouped(named, ["level", "name"], best.alias("best"), F.count("*").alias("group_size"))
    return named.join(groups, ["level", "name"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
