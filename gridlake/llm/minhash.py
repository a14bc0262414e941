"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's distinct word shingles are hashed once; the hash's top bits choose a bin and the least hash of each bin is kept. An empty bin borrows from
the first non-empty one in a random order of its own (optimal densification), so that bins of equal sets agree. Bands of bins are bucketed;
a bucket is a star around one member, whose choice differs by bucket, so its candidates grow with its members and not their pairs.

Candidates are confirmed on full shingle sets. Documents with equal sets are first one class (a 128-bit digest of the set), and only the class's smallest id goes
on. Confirmation goes in steps, each leaving out pairs whose ends are already in one component: first each document's most frequent
centre, then every star edge, then a few new stars among the members of a bucket that the first star left in other components. Stars only join
most members cheaply; what decides is the last step, which compares every two members of a bucket that are still in different components, in
blocks. Parities of the sets bound their differences there, so that only pairs that can be similar enough go on to full sets.

At J = 0.85 a pair misses all 25 bands of 5 bins with probability 4e-7.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, grouped, staged
from .components import components
from .packing import slices

WORDS = 5
PERCENT = 85
BINS = 128
BANDS, ROWS = 25, 5
#: Times that the members left in a bucket form a new star, before all that are still apart are compared.
NEW_STARS = 3
#: Members of a bucket that a block holds, about, and bits of a set's parities.
BLOCK, BITS = 512, 1024
SEGMENT = 1 << 18

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


BYTE = _numbers(256, 1)
BYTE[65:91] = BYTE[97:123]  # A-Z count as a-z
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True
BASE = _U(0x9E3779B97F4A7C15)
INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, _U), np.full(n - 1, b, _U)]), dtype=_U) for b in (BASE, INVERSE))


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words of UTF-8 bytes, in segments that end between words."""
    found, starts, at = [], [], 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text):  # to the next blank
            gap = np.flatnonzero(BLANK[text[end : end + 4096]])
            if len(gap):
                end += int(gap[0])
                break
            end += 4096
        part = text[at : min(end, len(text))]
        blank = np.concatenate([[True], BLANK[part], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        s, e = edge[::2], edge[1::2]
        if len(s):
            size = 1 << max(18, int(len(part)).bit_length())
            up, down = _powers(size)
            total = np.concatenate([np.zeros(1, _U), np.cumsum(BYTE[part] * up[: len(part)], dtype=_U)])
            found.append(_mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)))
            starts.append(s + at)
        at = end
    none = np.zeros(0)
    return (np.concatenate(found), np.concatenate(starts)) if found else (none.astype(_U), none.astype(np.int64))


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than ``words`` are one shingle, none are the empty set."""
    joined = np.frombuffer(b" ".join(texts), np.uint8)
    h, at = word_hashes(joined)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(at, np.concatenate([[0], ends]))
    weight = _numbers(words, 2)
    every = sum((h[k : max(0, len(h) - words + 1 + k)] * weight[k] for k in range(1, words)), h[: max(0, len(h) - words + 1)] * weight[0])
    every = _mix(every + _U(words))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(every[a : b - words + 1]))
        elif b > a:
            out.append(_mix(np.array([(h[a:b] * weight[: b - a]).sum(dtype=_U) + _U(b - a)], _U)))
        else:
            out.append(h[:0])
    return out


@functools.cache
def _probes() -> np.ndarray:
    """For each bin a random order of all bins."""
    return np.argsort(_numbers(BINS * BINS, 3).reshape(BINS, BINS), axis=1)


def one_permutation(shingles: np.ndarray) -> np.ndarray:
    """``BINS`` values of a non-empty sorted set: the least hash of each bin, empty bins densified."""
    bound = np.searchsorted(shingles >> _U(64 - BINS.bit_length() + 1), np.arange(BINS + 1, dtype=_U))
    full = bound[1:] > bound[:-1]
    values = shingles[np.minimum(bound[:-1], len(shingles) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _probes()[empty]
        donor = order[np.arange(len(empty)), full[order].argmax(axis=1)]
        values[empty] = values[donor]
    return values


def band_keys(shingles: np.ndarray) -> np.ndarray:
    v = one_permutation(shingles)[: BANDS * ROWS].reshape(BANDS, ROWS)
    return _mix((v * _numbers(ROWS, 4)).sum(axis=1, dtype=_U) + _numbers(BANDS, 5)).view(np.int64)


def _set_digest(s: np.ndarray) -> tuple[int, int]:
    x = np.array([_mix(s).sum(dtype=_U), _mix(s + _U(0x9E3779B97F4A7C15)).sum(dtype=_U)], _U).view(np.int64)
    return int(x[0]), int(x[1])


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, n, d1, d2, bands`` of each row: set size, digest of the set, band keys (null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()])
            digests = [_set_digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "d1", "d2", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """``n, d1, d2, shingles`` of each row: the whole set and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets([(t or "").encode() for t in batch.column("text").to_pylist()])
            digests = [_set_digest(s) for s in sets]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1))]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            shingles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*columns, shingles], ["n", "d1", "d2", "shingles"])

    return docs.mapInArrow(run, "n long, d1 long, d2 long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``a, b`` of ``pairs`` with 100 * intersection >= percent * union, on full sets.

    Expressions and no Python: a row is two whole sets, and a batch of them has no bound in bytes.
    """
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y"))
    x, y, same = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    enough = F.when(100 * F.least(x, y) >= percent * F.greatest(x, y), 100 * same >= percent * (x + y - same)).otherwise(False)
    return pairs.join(left, "a").join(right, "b").filter(enough).select("a", "b")


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether each of ``BITS`` classes of hashes has an odd number of members: two sets differ in at least as many shingles as in bits."""
    odd = np.bincount((shingles & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(_U)


def _marks(sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.values.to_numpy().view(_U) for x in batch.column("shingles")]
            marks = pa.array([parities(s).tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(s) for s in found], pa.int64()), marks], ["doc", "n", "marks"])

    return sets.select("doc", "shingles").mapInArrow(lambda batches: run(slices(batches, "shingles")), "doc long, n long, marks binary")


def _apart(stars: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b`` of all members of a bucket in different components that sizes and parities let reach ``percent``.

    Only buckets with several components go on. Their largest component is dealt into blocks of its own, which meet the other members but not one another,
    so that a large group with a few others beside it costs its members once.
    """
    part = F.coalesce("p", "doc")
    members = stars.select("h", "doc").join(parts.select(F.col("node").alias("doc"), F.col("component").alias("p")), "doc", "left").select("h", "doc", part.alias("part"))
    mixed = grouped(members, ["h"], F.min("part").alias("p0"), F.max("part").alias("p1")).filter("p0 <> p1").select("h")
    members = checkpointed(members.join(mixed, "h"))
    each = members.groupBy("h", "part").agg(F.count("*").alias("size"))
    blocks = grouped(each, ["h"], F.max_by("part", F.struct("size", "part")).alias("main"), F.max("size").alias("large"), F.sum("size").alias("all"))
    blocks = blocks.select("h", "main", F.ceil(F.col("large") / BLOCK).alias("mains"), F.ceil((F.col("all") - F.col("large")) / BLOCK).alias("rests"))
    salt, main = F.xxhash64(F.lit(17), "doc"), F.col("part") == F.col("main")
    dealt = members.join(blocks, "h").withColumn("g", F.when(main, F.col("rests") + F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("rests"))))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") + F.when(main, 0).otherwise(F.col("mains")) - 1)))
    dealt = dealt.select("h", F.least("g", "x").alias("i"), F.greatest("g", "x").alias("j"), "g", "doc", "part")
    loaded = dealt.join(_marks(sets.join(members.select("doc").distinct(), "doc", "left_semi")), "doc")

    def pairs(b: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        g, i, j, doc, part, n = (b.column(k).to_numpy() for k in ("g", "i", "j", "doc", "part", "n"))
        marks = np.frombuffer(b"".join(b.column("marks").to_pylist()), _U).reshape(-1, BITS // 64)
        found = [np.zeros((0, 2), np.int64)]
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            at = np.arange(a, z)
            left, right = at[g[a:z] == i[a]], at[g[a:z] == j[a]]
            for k in left.tolist():
                y = right[(part[right] != part[k]) & (doc[right] > doc[k] if i[a] == j[a] else True)]
                both, low, high = n[y] + n[k], np.minimum(n[y], n[k]), np.maximum(n[y], n[k])
                y, both = (v[100 * low >= percent * high] for v in (y, both))
                # With s the sum of the sizes and d their difference in shingles, the similarity is (s - d) / (s + d).
                d = np.bitwise_count(marks[y] ^ marks[k]).sum(axis=1, dtype=np.int64)
                y = y[100 * (both - d) >= percent * (both + d)]
                found.append(np.stack([np.minimum(doc[y], doc[k]), np.maximum(doc[y], doc[k])], axis=1))
        ab = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            now = b if held is None else pa.concat_batches([held, b])
            h, i, j = (now.column(k).to_numpy() for k in ("h", "i", "j"))
            cuts = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            end = int(cuts[-1]) if len(cuts) else 0  # the last pair of blocks may go on in the next batch
            if end:
                yield pairs(now.slice(0, end), np.concatenate([[0], cuts]))
            held = now.slice(end)
        if held is not None and held.num_rows:
            yield pairs(held, np.array([0, held.num_rows]))

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return loaded.repartition(n, "h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def minhash_dedup(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of anything but ASCII blanks, A-Z lower-cased; shingles are of five words. ``component_id`` is the smallest doc_id reachable by links
    of at least ``percent`` in a hundred Jaccard similarity, itself included; the empty set links with nothing. ``doc_id`` must be
    an integer and stands for its document: rows that repeat an id with other texts are compared each by its own text, and all rows of the id share the smallest
    of their components. Rows with a null id come back unlinked with a null component and not kept. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = staged(signatures(docs), "signatures")
    some = sigs.filter("n > 0 and doc_id is not null")
    key = ["n", "d1", "d2"]
    classes = some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    # One id can be the least of several classes, so each has a number of its own, fixed by writing it.
    classes = staged(classes.withColumn("doc", F.monotonically_increasing_id()), "classes")
    copies = some.select(*key, "doc_id").join(classes.filter("size > 1").select(*key, "rep", "doc"), key).filter("doc_id <> rep").select("doc", "rep", "doc_id")

    # A bucket is a hash of a band's number and values.
    rows = classes.select("doc", F.explode("bands").alias("h"))
    order = F.struct(F.xxhash64("h", "doc").alias("o"), F.col("doc"))
    centres = grouped(rows, ["h"], F.min(order)["doc"].alias("centre"), F.count("*").alias("size")).filter("size > 1").select("h", "centre")
    stars = staged(rows.join(centres, "h"), "stars")  # every row of a bucket with others
    edges = staged(stars.filter("doc <> centre").groupBy("doc", "centre").agg(F.count("*").alias("shared")), "edges")
    wanted = classes.join(stars.select("doc").distinct(), "doc", "left_semi").select(*key, "rep", "doc")
    texts = docs.join(wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    # Sets are shuffled once: the join finds them dealt by its keys.
    once = _sets(texts).groupBy(*key).agg(F.first("shingles").alias("shingles"))
    sets = staged(once.join(wanted.select(*key, "doc"), key).select("doc", "shingles"), "sets")

    best = edges.groupBy("doc").agg(F.max_by("centre", F.struct("shared", "centre")).alias("centre"))
    links = checkpointed(_confirmed(best.select(*_pair("doc", "centre")).distinct(), sets, percent))
    tried, left, parts = None, stars, None
    for step in range(NEW_STARS + 1):
        parts = parts or checkpointed(components(links))
        of = lambda name, out: parts.select(F.col("node").alias(name), F.col("component").alias(out))  # noqa: B023, E731
        if step == 0:
            pairs = edges.select("doc", "centre")
        else:
            # Members of a bucket outside the last centre's component form a new star.
            part = F.coalesce("p", "doc")
            left = left.join(of("doc", "p"), "doc", "left").join(of("centre", "q"), "centre", "left")
            left = left.filter(part != F.coalesce("q", "centre")).select("doc", "h", part.alias("part"))
            again = grouped(left, ["h"], F.min(order)["doc"].alias("centre"), F.min("part").alias("p0"), F.max("part").alias("p1"))
            left = checkpointed(left.select("doc", "h").join(again.filter("p0 <> p1").select("h", "centre"), "h"))
            pairs = left.filter("doc <> centre").select("doc", "centre").distinct()
        apart = pairs.join(of("doc", "p"), "doc", "left").join(of("centre", "q"), "centre", "left").filter(F.coalesce("p", "doc") != F.coalesce("q", "centre"))
        fresh = apart.select(*_pair("doc", "centre")).distinct()
        fresh = checkpointed(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            if step:
                break
            continue
        tried = fresh if tried is None else tried.unionByName(fresh)
        links, parts = checkpointed(links.unionByName(_confirmed(fresh, sets, percent))), None
    parts = parts or checkpointed(components(links))
    # Whatever the stars left untested in a bucket, and its members already joined, as possible partners.
    fresh = _apart(stars, parts, sets, percent)
    fresh = checkpointed(fresh if tried is None else fresh.join(tried, ["a", "b"], "left_anti"))
    if not fresh.isEmpty():
        parts = checkpointed(components(links.unionByName(_confirmed(fresh, sets, percent))))
    # From class numbers to ids. A copy is never the least of its class and only takes over the component, unless its id has other texts too.
    reps = classes.select("doc", "rep")
    named = parts.join(reps, parts["node"] == reps["doc"]).select("component", "rep")
    least = checkpointed(named.groupBy("component").agg(F.min("rep").alias("least")))
    node = checkpointed(parts.join(least, "component").select(F.col("node").alias("doc"), "least"))
    several = some.select("doc_id", *key).distinct().groupBy("doc_id").agg(F.count("*").alias("texts")).filter("texts > 1").select("doc_id")
    several = checkpointed(several)
    ids = reps.join(node, "doc", "left").select(F.col("rep").alias("node"), F.coalesce("least", "rep").alias("component"))
    taken = copies.join(node, "doc", "left").select(F.col("doc_id").alias("node"), F.coalesce("least", "rep").alias("component"))
    found = ids.filter("node <> component").unionByName(taken).groupBy("node").agg(F.min("component").alias("component"))
    if not several.isEmpty():
        links = checkpointed(ids.unionByName(taken).filter("node <> component"))
        found = components(links.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = sigs.select("doc_id", F.col("n").alias("n_shingles")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    part = F.coalesce("component", "doc_id")
    discard(edges, stars, sets)
    return out.select("doc_id", "n_shingles", part.alias("component_id"), F.coalesce(F.col("doc_id") == part, F.lit(False)).alias("kept"))
