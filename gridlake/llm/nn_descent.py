"""Near-duplicate embeddings by NN-descent.

Vectors are compared within a label. Identical vectors are one class first. Random sign projections order the vectors of a label, and neighbours in these orders
give each vector its first neighbour list. Then NN-descent: around every vector its neighbours, forward and reverse, are
compared with each other, and each vector keeps the ``K`` best it has met. A list whose entries are all at the threshold or above is saturated and
grows, twofold a round, up to ``MOST``. A list at ``MOST`` keeps its ``FAR`` most distant links beside the nearest: those lead out of a dense group.

The links found make components. An audit compares some vectors of every label with the whole label, in blocks, and judges by vector, those with few links apart
from those with many, how many of its true links lie in its own component. A failed audit brings new orders and further rounds; one that saw too few vectors with
links draws more of them. A label that no audit passed in the end is compared whole, in the same blocks. Links that audits find between components are kept.

Which vectors link, and how many, is then settled in each component, again in blocks that give counts and not pairs: a dense group of any size costs its vectors
a row a block, and no pair of it is ever a row.

Plan: lists, reverse lists and comparisons are bounded for each vector, and cut before the shuffle where a vector is everyone's neighbour. Vectors travel as bytes of their own
precision and cosines are computed in double.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import checkpointed, discard, grouped, staged
from .components import components

THRESHOLD = 0.98
#: Entries of a list, and of one that saturates again and again.
K, MOST = 6, 48
#: Links of the ``MOST`` that are the farthest and not the nearest.
FAR = 8
#: Entries of lists and reverse lists around a vector that a round compares.
AROUND = 32
ORDERS = 6
BITS = 10
NEXT = 4
MAX_ROUNDS = 6
#: A round that brings fewer vectors than this share a first link is the last before an audit.
STILL = 0.001
#: Vectors of a label that the first audit draws, about, how many times as many each further one does, and how many audits there are.
AUDIT, MORE, AUDITS = 1000, 8, 3
#: How many vectors with links, but fewer than ``K``, an audit has to find for a verdict.
ENOUGH = 50
RECALL = 0.999
#: Vectors that a side of a block of comparisons holds, about, and into how many sides a component is dealt at least, if each gets ``LEAST`` vectors.
SIDE, SPREAD, LEAST = 2048, 8, 64


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Rows of ``kind`` numbers in bytes as unit vectors in double."""
    m = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    m = m / np.abs(m).max(axis=1)[:, None]  # so that no square overflows
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _kind(vectors: DataFrame, embedding: str) -> str:
    """Floats travel as such; anything else as doubles."""
    return "<f4" if dict(vectors.dtypes)[embedding] == "array<float>" else "<f8"


def comparable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """All rows as ``vec, space, e``; ``space`` (a label and dimension) is null for what links with nothing."""
    x = F.col("e")
    fine = (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))) & F.exists(x, lambda c: c != 0)
    element = "float" if _kind(vectors, embedding) == "<f4" else "double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec"), F.col(label).alias("label"), F.col(embedding).cast(f"array<{element}>").alias("e"))
    space = F.when(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)), F.xxhash64(F.col("label").cast("string"), F.size("e")))
    return rows.select("vec", space.alias("space"), "e")


def _packed(rows: DataFrame, kind: str) -> DataFrame:
    """``v``: the bytes of ``e``."""
    others = [f for f in rows.schema if f.name != "e"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [np.asarray(x, kind).tobytes() for x in b.column("e").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in others), pa.array(v, pa.binary())], [*(f.name for f in others), "v"])

    return rows.mapInArrow(run, rows.drop("e").schema.add("v", "binary"))


def _by_key(batches: Iterator[pa.RecordBatch], keys: list[str], each: Callable[[pa.RecordBatch, np.ndarray], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``each`` of a batch of whole groups and where they begin and end; rows are sorted by ``keys``, and a group can go on in the next batch."""
    held = None
    for b in batches:
        now = b if held is None else pa.concat_batches([held, b])
        columns = [now.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        end = int(cuts[-1]) if len(cuts) else 0
        if end:
            yield from each(now.slice(0, end), np.concatenate([[0], cuts]))
        held = now.slice(end)
    if held is not None and held.num_rows:
        yield from each(held, np.array([0, held.num_rows]))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


# 1. The neighbour graph


def first_lists(reps: DataFrame, kind: str, seed: int) -> DataFrame:
    """``u, v, sim`` of vectors close in random orders of their label."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            size = np.array([len(x) for x in whole.column("v").to_pylist()])
            for n in np.unique(size):
                b = whole.filter(pa.array(size == n))
                m = _matrix(b.column("v"), kind)
                for t in range(ORDERS):
                    z = m @ np.random.default_rng(seed * 1000 + t).standard_normal((m.shape[1], BITS + 1))
                    bucket = (z[:, :BITS] > 0) @ (1 << np.arange(BITS))
                    yield pa.RecordBatch.from_arrays(
                        [b.column("vec"), b.column("space"), pa.array(np.full(len(m), t, np.int32)), pa.array(bucket.astype(np.int64)), pa.array(z[:, BITS]), b.column("v")],
                        ["vec", "space", "t", "bucket", "at", "v"],
                    )

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            now = b if last is None else pa.concat_batches([last, b])
            ids, space, t = (now.column(c).to_numpy() for c in ("vec", "space", "t"))
            size = np.array([len(x) for x in now.column("v").to_pylist()])
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for n in np.unique(size):  # one label can hold vectors of several lengths, in spaces of their own
                k = np.flatnonzero(size == n)
                m = _matrix(now.column("v").take(pa.array(k)), kind)
                for step in range(1, NEXT + 1):
                    a, c = k[:-step], k[step:]
                    ok = (space[a] == space[c]) & (t[a] == t[c]) & (ids[a] != ids[c])
                    out.append((ids[a][ok], ids[c][ok], (m[:-step] * m[step:]).sum(axis=1)[ok]))
            u, v, s = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(s)], ["u", "v", "sim"])
            last = now.slice(max(0, now.num_rows - NEXT))

    rows = reps.select("vec", "space", "v").mapInArrow(keys, "vec long, space long, t int, bucket long, at double, v binary")
    dealt = rows.repartitionByRange(_partitions(reps), "space", "t", "bucket", "at").sortWithinPartitions("space", "t", "bucket", "at", "vec")
    return dealt.mapInArrow(link, "u long, v long, sim double")


def keep_best(edges: DataFrame, threshold: float, most: int) -> DataFrame:
    """Each vector's ``K`` best of ``edges`` (in either direction) and, at the threshold or above, ``most``, with their ``rank``.

    ``old`` is 0 for what was there before. Lists at ``MOST`` come with the farthest links too, which can repeat some of the nearest.
    """
    pairs = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("sim").alias("sim"), F.min("old").alias("old"))
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "old"))
    # Nothing beyond the first ``most`` of a vector is shuffled, however many lists it is in.
    linked = F.col("sim") >= threshold
    near = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))
    best = both.withColumn("rank", near).filter(F.col("rank") <= most).filter((F.col("rank") <= K) | linked)
    if most < MOST:
        return best
    distant = F.row_number().over(W.partitionBy("u").orderBy("sim", "v"))
    return best.unionByName(both.filter(linked).withColumn("rank", distant).filter(F.col("rank") <= FAR).withColumn("rank", F.col("rank") + MOST))


def local_join(lists: DataFrame, reps: DataFrame, kind: str, seed: int, threshold: float, most: int) -> DataFrame:
    """``u, v, sim`` of members around each vector: pairs that are news to one of them."""
    around = lists.select(F.col("u").alias("c"), F.col("v").alias("x"), "old").unionByName(lists.select(F.col("v").alias("c"), F.col("u").alias("x"), "old"))
    rank = F.row_number().over(W.partitionBy("c").orderBy(F.desc("old"), F.xxhash64(F.lit(seed), "c", "x")))
    members = around.withColumn("rank", rank).filter(F.col("rank") <= AROUND).select("c", "x", F.col("old").alias("fresh"))
    # What is under a vector's floor cannot enter its list.
    own = lists.groupBy("u").agg(F.count("*").alias("n"), F.min("sim").alias("low"))
    open_end = float(np.nextafter(threshold, -1))
    floor = F.when(F.col("n") < K, -2.0).when(F.col("low") < threshold, F.col("low")).when(F.col("n") < most, open_end).otherwise(F.col("low"))
    info = reps.select(F.col("vec").alias("x"), "v").join(own.select(F.col("u").alias("x"), floor.alias("floor")), "x")
    loaded = members.join(checkpointed(info), "x").select("c", "x", "fresh", "v", "floor")

    def compare(batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        x, fresh, floor = (batch.column(k).to_numpy() for k in ("x", "fresh", "floor"))
        raw = batch.column("v")
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            new = fresh[i:j] > 0
            if j - i > 1 and new.any():
                m = _matrix(raw.slice(i, j - i), kind)
                s = np.clip(m @ m.T, -1, 1)
                f, here = floor[i:j], x[i:j]
                news = ((s > f[:, None]) | (s > f[None, :])) & (new[:, None] | new[None, :]) & (here[:, None] != here[None, :])
                p, q = np.nonzero(np.triu(news, 1))  # a neighbour both ways comes twice
                out.append((here[p], here[q], s[p, q]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(k)) for k in zip(*out)], ["u", "v", "sim"])

    dealt = loaded.repartition(_partitions(reps), "c").sortWithinPartitions("c", "x")
    return dealt.mapInArrow(lambda batches: _by_key(batches, ["c"], compare), "u long, v long, sim double")


def descend(reps: DataFrame, kind: str, seed: int, threshold: float, lists: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Lists (those given and those of new orders) after rounds of NN-descent, and the links ``u, v`` in them."""
    n = reps.count()
    first = first_lists(reps, kind, seed).withColumn("old", F.lit(1))
    first = first if lists is None else lists.withColumn("old", F.lit(0)).drop("rank").unionByName(first)
    lists, most, linked = checkpointed(keep_best(first, threshold, K)), K, -1
    for turn in range(MAX_ROUNDS):
        most = min(2 * most, MOST)
        news = local_join(lists, reps, kind, seed * 100 + turn, threshold, most).withColumn("old", F.lit(1))
        held = lists.withColumn("old", F.lit(0)).drop("rank")
        before, lists = lists, checkpointed(keep_best(held.unionByName(news), threshold, most))
        discard(before)
        had, linked = linked, lists.filter((F.col("rank") == 1) & (F.col("sim") >= threshold)).count()
        if had >= 0 and linked - had <= STILL * n:
            break
    links = lists.filter(F.col("sim") >= threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return lists, checkpointed(links.distinct())


# 2. Comparisons in blocks


def compared(left: DataFrame, right: DataFrame, group: str, kind: str, threshold: float, spread: int = 1) -> DataFrame:
    """``u, part, v, n, weight``: of each vector of ``left``, by the component of what it links with among the vectors of ``right`` in its ``group``, one of
    them, their number and weight. Blocks of ``SIDE`` vectors meet; each gives counts and no pairs.

    ``left``: ``group, vec, v``; ``right``: ``group, vec, v, part, weight``.
    """

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        n = F.count("*")
        return rows.groupBy(group).agg(F.greatest(F.ceil(n / SIDE), F.least(F.lit(spread).cast("long"), F.ceil(n / LEAST))).alias(name))

    sides = checkpointed(blocks(left, "lefts").join(blocks(right, "rights"), group))
    own = lambda n: F.pmod(F.xxhash64(F.lit(23), "vec"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    none = F.lit(None).cast("long")
    a = left.join(sides, group).select(group, own("lefts").alias("i"), every("rights").alias("j"), F.lit(0).alias("side"), "vec", "v", none.alias("part"), none.alias("weight"))
    b = right.join(sides, group).select(group, every("lefts").alias("i"), own("rights").alias("j"), F.lit(1).alias("side"), "vec", "v", "part", "weight")

    def meet(batch: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        side, ids, raw = batch.column("side").to_numpy(), batch.column("vec").to_numpy(), batch.column("v")
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            cut = p + int(np.searchsorted(side[p:q], 1))
            if not p < cut < q:
                continue
            x, y = ids[p:cut], ids[cut:q]
            part, weight = (batch.column(k).slice(cut, q - cut).to_numpy() for k in ("part", "weight"))
            near = _matrix(raw.slice(p, cut - p), kind) @ _matrix(raw.slice(cut, q - cut), kind).T >= threshold
            near &= x[:, None] != y[None, :]
            u, v = np.nonzero(near)
            if not len(u):
                continue
            # Links come by vector; those of one component become a row.
            order = np.lexsort((part[v], u))
            u, v = u[order], v[order]
            at = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (part[v[1:]] != part[v[:-1]])]))
            n = np.diff(np.append(at, len(u)))
            yield pa.RecordBatch.from_arrays([pa.array(k) for k in (x[u[at]], part[v[at]], y[v[at]], n, np.add.reduceat(weight[v], at))], ["u", "part", "v", "n", "weight"])

    dealt = a.unionByName(b).repartition(_partitions(right), group, "i", "j").sortWithinPartitions(group, "i", "j", "side")
    found = dealt.mapInArrow(lambda batches: _by_key(batches, [group, "i", "j"], meet), "u long, part long, v long, n long, weight long")
    return found.groupBy("u", "part").agg(F.min("v").alias("v"), F.sum("n").alias("n"), F.sum("weight").alias("weight"))


def parts_of(reps: DataFrame, links: DataFrame) -> DataFrame:
    """``reps`` with ``part``, the component that ``links`` make of them."""
    found = components(links.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnsRenamed({"node": "vec", "component": "part"})
    return checkpointed(reps.join(found, "vec", "left").withColumn("part", F.coalesce("part", "vec")))


def audited(reps: DataFrame, draw: int, kind: str, threshold: float, wanted: float) -> tuple[DataFrame, DataFrame]:
    """``space, verdict`` of each label of ``reps`` by about ``draw`` of its vectors, and the links ``u, v`` between components that it found.

    The verdict is ``passed``, ``failed`` (recall under ``wanted``) or ``few`` (too few vectors with links for either); a label drawn whole has passed, as all it lacked is found.
    """
    drawn = reps.join(reps.groupBy("space").agg(F.count("*").alias("size")), "space")
    drawn = checkpointed(drawn.filter((F.col("size") <= draw) | (F.pmod(F.xxhash64(F.lit("audit"), "vec"), F.lit(1 << 62)) < F.lit(float(draw)) / F.col("size") * float(1 << 62))))
    true = checkpointed(compared(drawn, reps.withColumn("weight", F.lit(1).cast("long")), "space", kind, threshold))
    of = drawn.select(F.col("vec").alias("u"), "space", F.col("part").alias("own"))
    hit = F.sum(F.when(F.col("part") == F.col("own"), F.col("n")).otherwise(0))
    each = true.join(of, "u").groupBy("space", "u").agg(F.sum("n").alias("n"), hit.alias("hits"))
    by = each.groupBy("space", (F.col("n") < K).alias("few")).agg(F.count("*").alias("seen"), F.avg(F.col("hits") / F.col("n")).alias("recall"))
    by = by.groupBy("space").agg(F.min("recall").alias("recall"), F.sum(F.when(F.col("few"), F.col("seen")).otherwise(0)).alias("seen"))
    verdict = F.when(F.col("size") <= draw, "passed").when(F.col("recall") < wanted, "failed").when(F.coalesce("seen", F.lit(0)) < ENOUGH, "few").otherwise("passed")
    sizes = reps.groupBy("space").agg(F.count("*").alias("size"))
    missed = true.join(of, "u").filter("part <> own").select("u", "v")
    return checkpointed(sizes.join(by, "space", "left").select("space", verdict.alias("verdict"))), missed


def near_components(reps: DataFrame, kind: str, threshold: float = THRESHOLD, wanted: float = RECALL) -> DataFrame:
    """``reps`` (``vec, space, v`` of distinct vectors) with ``part``: the component of links at ``threshold`` or above."""
    lists, links = descend(reps, kind, 1, threshold)
    whole, open_ = parts_of(reps, links), reps
    for attempt in range(AUDITS):
        left = whole.join(open_.select("vec"), "vec", "left_semi")
        verdict, missed = audited(left, AUDIT * MORE**attempt, kind, threshold, wanted)
        links = checkpointed(links.unionByName(missed))
        open_ = checkpointed(open_.join(verdict.filter("verdict <> 'passed'").select("space"), "space", "left_semi"))
        if open_.isEmpty():
            break
        bad = checkpointed(open_.join(verdict.filter("verdict = 'failed'").select("space"), "space", "left_semi"))
        if attempt < AUDITS - 1 and not bad.isEmpty():
            own = lists.join(bad.select(F.col("vec").alias("u")), "u", "left_semi")
            lists, more = descend(bad, kind, 2 + attempt, threshold, own)
            links = checkpointed(links.unionByName(more))
        whole = parts_of(reps, links)
    if not open_.isEmpty():
        left = checkpointed(whole.join(open_.select("vec"), "vec", "left_semi"))
        true = compared(left, left.withColumn("weight", F.lit(1).cast("long")), "space", kind, threshold)
        missed = true.join(left.select(F.col("vec").alias("u"), F.col("part").alias("own")), "u").filter("part <> own").select("u", "v")
        links = checkpointed(links.unionByName(missed))
    return parts_of(reps, links)


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors link at a cosine of ``threshold`` or above, if their labels are equal and not null. A vector that is null, empty, zero or
    holds a null or non-finite component links with nothing. Identical vectors are linked with one another and share their links. ``vec_id`` is an integer;
    rows that repeat an id are vectors of their own for ``n_links``, and share the id's component. A null id links with nothing, has a null component and is not kept. An empty table gives an empty result.
    """
    kind = _kind(vectors, embedding)
    rows = comparable(vectors, vec_id, embedding, label)
    fine = rows.filter("space is not null")
    classes = fine.groupBy("space", "e").agg(F.min("vec").alias("rep"), F.count("*").alias("size"))
    # One id can be the least of several classes, so each has a number of its own, fixed by writing it.
    classes = staged(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    members = staged(fine.join(classes.select("space", "e", "id", "rep", "size"), ["space", "e"]).select("vec", "id", "rep", "size"), "members")
    reps = staged(_packed(classes.select(F.col("id").alias("vec"), "space", "size", "e"), kind), "reps")
    whole = near_components(reps.select("vec", "space", "v"), kind, threshold)
    info = checkpointed(whole.join(reps.select("vec", F.col("size").alias("weight")), "vec"))
    # A component of one class needs no comparison.
    shared = grouped(info, ["part"], F.count("*").alias("n")).filter("n > 1").select("part")
    joint = checkpointed(info.join(shared, "part").withColumn("group", F.col("part")))
    links = compared(joint, joint, "group", kind, threshold, SPREAD).select(F.col("u").alias("id"), "weight")
    links = checkpointed(links)

    least = info.join(classes.select(F.col("id").alias("vec"), "rep"), "vec").select(F.col("vec").alias("id"), "part", "rep")
    least = checkpointed(least)
    lowest = checkpointed(least.join(grouped(least, ["part"], F.min("rep").alias("low")), "part").select("id", "low"))
    # Stars already, unless an id has several vectors.
    edges = members.join(lowest, "id").select(F.col("vec").alias("a"), F.col("low").alias("b"))
    found = components(edges.filter("a <> b"))
    counted = members.join(links, "id", "left").select("vec", (F.col("size") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"))
    linked = counted.join(found.withColumnRenamed("node", "vec"), "vec", "left")
    part = F.coalesce("component", "vec")
    out = linked.select(F.col("vec").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), part.alias("component_id"), (F.col("vec") == part).alias("kept"))
    rest = rows.filter("space is null").select("vec").join(found.withColumnRenamed("node", "vec"), "vec", "left")
    return out.unionByName(rest.select(F.col("vec").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), part.alias("component_id"), F.coalesce(F.col("vec") == part, F.lit(False)).alias("kept")))
