"""Cross-site boilerplate lines, found by how many sites carry them; DataFrame operations only.

A line belongs to the boilerplate if it stands on at least ``min_sites`` distinct sites. Sites are counted by HyperLogLog
sketches, one per line hash, which partial aggregation merges. A sketch errs, so lines whose estimate is near the threshold get an
exact distinct count; far from it the estimate decides.

Plan: lines become 16-byte hashes at the scan. One aggregation counts rows, bounds the sites and fills the sketches; all of that combines
map-side, so a line that a third of all rows hold costs a row a task. Lines near the threshold meet their rows again, dealt by (line, slice of sites), so that a hot
line is spread over ``SLICES`` tasks, whose counts of distinct sites add up. What to cut from a text depends on the text alone: places are joined by a digest of the text and
not by a row's number, so evaluating the input twice cannot mix rows up. Both joins stand between plain exchanges, where adaptive execution splits hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, fresh, grouped

MIN_SITES = 10
MIN_CHARS = 20
LG_K = 12
#: Six standard errors of a sketch with 2**LG_K registers (1.04 / sqrt(4096) each).
MARGIN = 6 * 1.04 / 2 ** (LG_K / 2)
#: Parts of a line's sites that are counted apart.
SLICES = 16


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hash(line: Column) -> Column:
    norm = F.trim(line)
    return F.struct(F.xxhash64(norm).alias("a"), F.xxhash64(F.lit(11), norm).alias("b"))


def _hashes(text: str, min_chars: int) -> Column:
    """The distinct hashes of a text's lines of at least ``min_chars`` characters."""
    return F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.char_length(F.trim(x)) >= min_chars), _hash))


def _places(docs: DataFrame, of: Column, text: str, min_chars: int) -> DataFrame:
    """``of, a, b`` of each line hash of a text, once.

    An inner explode would have the planner hash all lines twice, once to filter texts that have some.
    """
    every = docs.select(of, F.explode_outer(_hashes(text, min_chars)).alias("h"))
    return every.filter("h is not null").select(every.columns[0], F.col("h.a").alias("a"), F.col("h.b").alias("b"))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text", site: str = "source") -> DataFrame:
    """``h, n_sites`` of each line (its hash, blanks at the ends trimmed) of at least ``min_chars`` characters on at least ``min_sites`` sites.

    A null site is no site. ``n_sites`` is exact for lines near the threshold and an estimate for others.
    """
    rows = _places(docs.filter(F.col(site).isNotNull()), F.col(site).alias("site"), text, min_chars)
    seen = rows.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("site").alias("s0"), F.max("site").alias("s1"), F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    # A line needs as many rows as sites, and two sites differ.
    often = seen.filter((F.col("n") >= min_sites) & ((F.col("s0") != F.col("s1")) | F.lit(min_sites <= 1)))
    est = checkpointed(often.select("a", "b", F.hll_sketch_estimate("sketch").alias("est")))
    # The band is at least one site wide on either side, so that rounding cannot decide.
    low, high = min(min_sites * (1 - MARGIN), min_sites - 1), max(min_sites * (1 + MARGIN), min_sites + 1)
    sure = est.filter(F.col("est") > high).select("a", "b", F.col("est").alias("n_sites"))
    near = est.filter(F.col("est").between(low, high)).select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("slice"))
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("site"), F.lit(SLICES)).cast("int"))
    each = sliced.join(near, ["a", "b", "slice"], "left_semi").groupBy("a", "b", "slice").agg(F.countDistinct("site").alias("n"))
    exact = each.groupBy("a", "b").agg(F.sum("n").alias("n_sites"))
    return sure.unionByName(exact.filter(F.col("n_sites") >= min_sites)).select(F.struct("a", "b").alias("h"), "n_sites")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, text: str = "text", site: str = "source") -> DataFrame:
    """All columns of ``docs`` with boilerplate lines cut from ``text``, then ``n_lines`` and ``n_removed`` (named with a leading underscore if taken).

    A line ends at a line feed; the lines that stay are joined by line feeds in their order, so a text without
    boilerplate does not change. Null texts stay null with 0 lines; an empty text is one empty line. Lines under ``min_chars`` characters,
    trimmed, always stay, as do all lines of documents whose only occurrences are on few sites. Equal texts are cut alike whatever their
    ``doc_id``, so repeated rows and null ids are kept. Empty tables give empty results.
    """
    key, bad, n_lines, n_removed = fresh(docs, "_key", "_bad", "n_lines", "n_removed")
    digest = F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(5), F.col(text)).alias("y"))
    found = checkpointed(boilerplate_lines(docs, min_sites, min_chars, text, site).select(F.col("h.a").alias("a"), F.col("h.b").alias("b")))
    places = _places(docs.filter(F.col(text).isNotNull()), digest.alias("k"), text, min_chars)
    # Copies of a text report each line once a task.
    hit = grouped(places.join(found, ["a", "b"]), ["k"], F.collect_set(F.struct("a", "b")).alias(bad)).withColumnRenamed("k", key)
    marked = docs.withColumn(key, digest).join(hit, key, "left")
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains(F.col(bad), _hash(x)))
    cut = F.when(F.col(bad).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    total = F.coalesce(F.size(_lines(F.col(text))).cast("long"), F.lit(0).cast("long"))
    out = marked.withColumn(n_lines, F.when(F.col(text).isNull(), F.lit(0).cast("long")).otherwise(total))
    out = out.withColumn(n_removed, F.when(F.col(bad).isNull(), F.lit(0).cast("long")).otherwise(total - F.size(kept)))
    return out.withColumn(text, cut).select(*docs.columns, n_lines, n_removed)
