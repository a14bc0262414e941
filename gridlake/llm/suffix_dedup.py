"""Removal of passages that an earlier document has, by a distributed difference-cover suffix sort.

A byte goes if a ``LENGTH``-byte string that also starts in a document with a smaller id covers it. Strings are judged on the input and never cross documents.

1. Routing. Two equal strings hold equal windows of ``GRAM``-byte grams and so choose the same least gram hash (winnowing); runs of start
   positions with one least gram form a segment. Grams that only one document has are set aside; the rest is exact, not sampled.
   Gram hashes travel packed, and a slice of documents reports a gram once, however many of its documents hold it.
2. Segments of a gram meet in one block. Equal segments are one, with the smallest document, before they are shuffled.
   A gram that has one segment then is done, as all its strings have that document.
3. Each block is sorted as a suffix array by the difference cover modulo 3: sort and name the triples at
   positions 1 and 2 mod 3, recurse on the names, sort the remaining suffixes by their first byte and the rank that follows, merge. The recursion ends when names are unique or cover ``LENGTH`` bytes, since
   only prefixes of that length count. Adjacent prefixes are compared, and each group of equal strings takes its smallest document.
4. The verdicts go back to all occurrences of a segment by an equi-join on its digest, and a document's removed runs are the union.

A gram with more than ``HOT`` bytes of different segments (the edge of a passage that a third of all documents quote) would make a block too large:
its segments are cut into single strings, which a plain aggregation by their 128-bit digests settles. Exact copies of a whole text need no search: a copy goes
whole if it is long enough, and its first document stands for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType

from .common import discard, grouped, staged
from .minhash import _mix
from .packing import slices

LENGTH = 50
GRAM = 24
#: Bytes of different segments of one gram that a task sorts as one block, at most.
HOT = 2 << 20
#: Bytes that a worker winnows, or sorts as one suffix array, at a time.
CHUNK = 1 << 17
BLOCK_BYTES = 1 << 17
#: Bytes of segments that a task sorts, block after block.
TASK_BYTES = 32 << 20
#: Bytes of texts or segments taken up at a time; what is made of them is some tens of times as large.
TAKEN = 1 << 20
#: Start positions in a segment, at most.
LONGEST_RUN = 512
#: Gram hashes that a bucket holds, about, and that a packed row does at most.
BUCKET, ROW = 200_000, 40_000
_U = np.uint64
_P = [_U(pow(0x9E3779B97F4A7C15, 1 << i, 1 << 64)) for i in range(5)]


# 1. Winnowing


def _windows(text: np.ndarray, length: int) -> np.ndarray:
    """The least gram hash of each ``length``-byte string."""
    h = text.astype(_U) + _U(1)
    for i in range(3):  # grams of 2, 4, 8 bytes
        h = h[: -(1 << i)] * _P[i] + h[1 << i :]
    h = (h[:-16] * _P[3] + h[8:-8]) * _P[3] + h[16:]  # three of 8
    h = _mix(h)
    width, done = length - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[:-step], h[step:])
        done += step
    return h


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of start positions with one least gram, at most ``LONGEST_RUN`` long: text number, start, count, gram hash."""
    out = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        sizes = np.array([len(t) for t in texts[at:end]])
        if size >= length:
            first = np.concatenate([[0], np.cumsum(sizes)])
            m = _windows(np.frombuffer(b"".join(texts[at:end]), np.uint8), length)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            whole = owner[: len(m)] == owner[length - 1 :]
            new = np.concatenate([[True], (m[1:] != m[:-1]) | (owner[1 : len(m)] != owner[: len(m) - 1]) | (whole[1:] != whole[:-1])])
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(m)))
            keep = whole[start]
            start, count = start[keep], count[keep]
            if len(count) and count.max() > LONGEST_RUN:
                pieces = -(-count // LONGEST_RUN)
                nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start, left = np.repeat(start, pieces) + nth * LONGEST_RUN, np.repeat(count, pieces) - nth * LONGEST_RUN
                count = np.minimum(left, LONGEST_RUN)
            own = owner[start]
            out.append((own + at, start - first[own], count, m[start].view(np.int64)))
        at = end
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*out))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("b").to_pylist()]


def shared_grams(docs: DataFrame, bits: int, length: int) -> DataFrame:
    """``id, t, gram`` of each document's grams that another row has too (copies count)."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b"):
            owner, _, _, gram = runs(_texts(batch), length)
            ids, ts = batch.column("id").to_numpy(), batch.column("t").to_numpy()
            order = np.lexsort((owner, gram))
            o, g = owner[order], gram[order]
            if len(g):
                keep = np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])
                o, g = o[keep], g[keep]
            new = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
            known = ~new | np.concatenate([~new[1:], [False]]) if len(g) else new
            # Known here already: these need no bucket. The key only spreads them, in rows of a bounded size.
            ko, kg = o[known], g[known]
            key = lambda at: -1 - zlib.crc32(b"%d %d" % (ids[0], at))  # noqa: B023, E731
            rows = [(key(at), ids[ko[at : at + ROW]], ts[ko[at : at + ROW]], kg[at : at + ROW]) for at in range(0, len(kg), ROW)]
            o, g = o[new], g[new]
            # Least hashes crowd at the low end, so they are mixed once more to fill buckets evenly.
            bucket = (_mix(g.view(_U) ^ _U(0x9E3779B97F4A7C15)) >> _U(64 - bits)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            o, g, bucket = o[order], g[order], bucket[order]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(g) else []
            rows += [(int(bucket[i]), ids[o[i:j]], ts[o[i:j]], g[i:j]) for i, j in zip(cuts, [*cuts[1:], len(g)])]
            if not rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k].astype("<i8").tobytes() for r in rows], pa.binary()) for k in (1, 2, 3))], ["bucket", "id", "t", "gram"]
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(bucket: int, parts: list[tuple]) -> pa.RecordBatch:
            i, t, g = (np.concatenate([np.frombuffer(p[k], "<i8") for p in parts]) for k in range(3))
            if bucket >= 0:
                order = np.argsort(g, kind="stable")
                s = g[order]
                same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
                twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(s) else order
                i, t, g = i[twice], t[twice], g[twice]
            return pa.RecordBatch.from_arrays([pa.array(i), pa.array(t), pa.array(g)], ["id", "t", "gram"])

        now, parts = None, []
        for batch in slices(batches, "gram", TAKEN):
            for bucket, *part in zip(*(batch.column(c).to_pylist() for c in ("bucket", "id", "t", "gram"))):
                if parts and (bucket != now or bucket < 0):
                    yield result(now, parts)
                    parts = []
                now = bucket
                parts.append(part)
        if parts:
            yield result(now, parts)

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (1 << bits) // 4)
    packed = docs.select("id", "t", "b").mapInArrow(spread, "bucket long, id binary, t binary, gram binary")
    return packed.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(meet, "id long, t long, gram long")


def segments(docs: DataFrame, length: int) -> DataFrame:
    """``id, t, start, count, gram, seg`` of the runs whose gram is in the document's ``grams``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b", TAKEN):
            texts = _texts(batch)
            owner, start, count, gram = runs(texts, length)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            shared = [np.unique(np.asarray(g, np.int64)) for g in batch.column("grams").to_pylist()]
            bound = np.searchsorted(owner, np.arange(len(texts) + 1))
            hit = np.zeros(len(owner), bool)
            for k, s in enumerate(shared):
                a, b = bound[k], bound[k + 1]
                if len(s) and b > a:
                    at = np.searchsorted(s, gram[a:b])
                    hit[a:b] = s[np.minimum(at, len(s) - 1)] == gram[a:b]
            owner, start, count, gram = owner[hit], start[hit], count[hit], gram[hit]
            joined = np.frombuffer(b"".join(texts), np.uint8)
            size = count + length - 1
            ends = np.cumsum(size)
            where = np.repeat(offsets[owner] + start - (ends - size), size) + np.arange(size.sum())
            seg = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], ends]).astype("<i4").tobytes()), pa.py_buffer(joined[where].tobytes())])
            take = pa.array(owner.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(take), batch.column("t").take(take), pa.array(start.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(gram), seg],
                ["id", "t", "start", "count", "gram", "seg"],
            )

    return docs.select("id", "t", "b", "grams").mapInArrow(run, "id long, t long, start long, count int, gram long, seg binary")


# 3. The suffix array of a block


def _packed(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Rows as single numbers that sort by their columns in order, and a bound above these."""
    out, top = keys[0], int(keys[0].max(initial=0)) + 1
    for nxt in keys[1:]:
        base = int(nxt.max(initial=0)) + 1
        if top * base >= 1 << 62:  # too wide for one number: name what there is first
            values, out = np.unique(out, return_inverse=True)
            top = len(values)
        out, top = out * base + nxt, top * base
    return out, top


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of positive integers ``s``, sorted by at least their first ``depth`` symbols; suffixes equal so far may stand in any order."""
    n = len(s)
    t = np.zeros(n + 4, np.int64)
    t[:n] = s
    # Sort the triples at the sample positions.
    sample = np.concatenate([np.arange(1, n + 1, 3), np.arange(2, n + 1, 3)])
    triples, _ = _packed(t[:-2], t[1:-1], t[2:])
    triples = np.concatenate([triples[1 : n + 1 : 3], triples[2 : n + 1 : 3]])
    order = np.argsort(triples)
    if depth > 3:
        ranked = triples[order]
        new = ranked[1:] != ranked[:-1]
        if not new.all():  # name them and recurse on the names: those of one class, then of the other
            names = np.empty(len(sample), np.int64)
            names[order] = np.cumsum(np.concatenate([[True], new]))
            order = suffix_order(names, -(-depth // 3))
    ordered = sample[order]
    rank = np.zeros(n + 4, np.int64)
    rank[ordered] = np.arange(1, len(sample) + 1)
    # The remaining suffixes: a symbol, then the rank that follows.
    one, _ = _packed(t[: n + 2], rank[1 : n + 3])
    two, _ = _packed(t[: n + 2], t[1 : n + 3], rank[2 : n + 4])
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(one[::3][: len(rest)])]
    # Merge: how many of either kind stand before each of them. Where suffixes are equal to that depth the counts may fall, within what is equal.
    ordered = ordered[ordered < n]
    kind = ordered % 3 == 1
    before = np.searchsorted(one[ordered[kind]], one[rest]) + np.searchsorted(two[ordered[~kind]], two[rest])
    at = np.arange(len(rest)) + np.maximum.accumulate(before)
    out, free = np.empty(n, np.int64), np.ones(n, bool)
    out[at], free[at] = rest, False
    out[free] = ordered
    return out


def suffix_ranks(s: np.ndarray, depth: int) -> np.ndarray:
    """The place of each suffix in ``suffix_order``."""
    out = np.empty(len(s), np.int64)
    out[suffix_order(s, depth)] = np.arange(len(s))
    return out


def least_owner(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each start, the least owner of an equal ``length``-byte string among the starts."""
    at, is_start = np.empty(len(text), owner.dtype), np.zeros(len(text), bool)
    at[starts], is_start[starts] = owner, True
    p = suffix_order(text.astype(np.int64) + 1, length)
    p = p[is_start[p]]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((len(text),), "<u8", padded.data, 0, (1,))
    same = np.ones(max(0, len(p) - 1), bool)
    for k in [*range(0, length - 7, 8), length - 8]:  # compare adjacent prefixes, eight bytes at a time
        w = words[p + k]
        same &= w[1:] == w[:-1]
    group = np.flatnonzero(np.concatenate([[True], ~same]))
    low = np.minimum.reduceat(at[p], group)
    at[p] = np.repeat(low, np.diff(np.append(group, len(p))))
    return at[starts]


def _block(segs: list[bytes], first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges (offset, count) of strings that a smaller owner has, segment after segment, and where each segment's begin."""
    size = np.array([len(s) for s in segs])
    text = np.frombuffer(b"".join(segs), np.uint8)
    begin = np.cumsum(size) - size
    count = size - length + 1
    ends = np.cumsum(count)
    starts = np.repeat(begin - (ends - count), count) + np.arange(count.sum())
    owner = np.repeat(first, count)
    less = least_owner(text, starts, owner, length) < owner
    edge = np.zeros(len(less) + 1, bool)  # where a segment begins
    edge[ends - count] = edge[-1] = True
    opens = np.flatnonzero(less & (edge[:-1] | np.concatenate([[True], ~less[:-1]])))
    closes = np.flatnonzero(less & (edge[1:] | np.concatenate([~less[1:], [True]]))) + 1
    of = np.searchsorted(ends, opens, side="right")
    return opens - (ends - count)[of], closes - opens, np.searchsorted(of, np.arange(len(segs) + 1))


VERDICT = "s1 long, s2 long, first long, offs array<int>, lens array<int>"


def block_verdicts(distinct: DataFrame, length: int, partitions: int) -> DataFrame:
    """``gram, seg, first`` to ``VERDICT``.

    Equal strings have one gram, and the strings of a segment one owner: where a gram has one segment only, no string has a smaller owner, and there is nothing to sort.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(rows: pa.RecordBatch, offs: np.ndarray, lens: np.ndarray, begin: np.ndarray) -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(begin.astype(np.int32), x.astype(np.int32)) for x in (offs, lens)]
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("s1", "s2", "first")), *lists], ["s1", "s2", "first", "offs", "lens"])

        def block(rows: pa.RecordBatch) -> pa.RecordBatch:
            return result(rows, *_block(rows.column("seg").to_pylist(), rows.column("first").to_numpy(), length))

        def split(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            """Verdicts of lone segments, and of the others once they fill a block."""
            new = rows.column("gram").to_numpy()
            new = np.concatenate([[True], new[1:] != new[:-1], [True]])
            lone = new[:-1] & new[1:]
            alone, others = rows.filter(pa.array(lone)), rows.filter(pa.array(~lone))
            if alone.num_rows:
                yield result(alone, none, none, np.zeros(alone.num_rows + 1))
            if others.num_rows:
                held.append(others)
            if sum(h.column("seg").nbytes for h in held) >= BLOCK_BYTES:
                yield block(pa.concat_batches(held))
                held.clear()

        held, last, none = [], None, np.zeros(0)
        for batch in slices(batches, "seg", BLOCK_BYTES):
            now = batch if last is None else pa.concat_batches([last, batch])
            gram = now.column("gram").to_numpy()
            edge = np.flatnonzero(gram[1:] != gram[:-1])
            end = int(edge[-1]) + 1 if len(edge) else 0  # a gram's segments stay together
            if end:
                yield from split(now.slice(0, end))
            last = now.slice(end)
        if last is not None and last.num_rows:
            yield from split(last)
        if held:
            yield block(pa.concat_batches(held))

    return distinct.repartition(partitions, "gram").sortWithinPartitions("gram").select("gram", "seg", "s1", "s2", "first").mapInArrow(run, VERDICT)


def hot_verdicts(distinct: DataFrame, length: int) -> DataFrame:
    """The same for segments of hot grams, string by string."""
    at = F.sequence(F.lit(0), F.octet_length("seg") - length)
    strings = distinct.select("s1", "s2", "first", F.explode(F.transform(at, lambda i: F.struct(i.alias("i"), F.substring("seg", i + 1, F.lit(length)).alias("x")))).alias("w"))
    strings = strings.select("s1", "s2", "first", F.col("w.i").alias("i"), F.xxhash64("w.x").alias("x1"), F.xxhash64(F.lit(3), "w.x").alias("x2"))
    low = grouped(strings, ["x1", "x2"], F.min("first").alias("low"))
    less = strings.join(low, ["x1", "x2"]).filter("low < first").groupBy("s1", "s2").agg(F.collect_list("i").alias("offs"))
    out = distinct.select("s1", "s2", "first").join(less, ["s1", "s2"], "left")
    offs = F.coalesce("offs", F.array().cast("array<int>"))
    return out.select("s1", "s2", "first", offs.alias("offs"), F.transform(offs, lambda _: F.lit(1)).alias("lens"))


# 4. Documents


def _inner(t: bytes, a: int, z: int) -> tuple[int, int]:
    """The whole UTF-8 characters within a range."""
    while a < z and t[a] & 0xC0 == 0x80:
        a += 1
    while z > a and z < len(t) and t[z] & 0xC0 == 0x80:
        z -= 1
    return a, z


def _cut(batches: Iterator[pa.RecordBatch], whole_characters: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "b"):
        starts, ends, kept = [], [], []
        for t, found in zip(_texts(batch), batch.column("ranges").to_pylist()):
            if not found:
                starts.append([]), ends.append([]), kept.append(t)
                continue
            r = np.array([(x["a"], x["z"]) for x in found], np.int64)
            r = r[np.argsort(r[:, 0], kind="stable")]
            reach = np.maximum.accumulate(r[:, 1])
            new = np.concatenate([[True], r[1:, 0] > reach[:-1]])
            a, z = r[new, 0].tolist(), reach[np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)].tolist()
            if whole_characters:
                a, z = zip(*(_inner(t, i, j) for i, j in zip(a, z)))
            starts.append(a), ends.append(z)
            kept.append(b"".join(t[i:j] for i, j in zip([0, *z], [*a, len(t)])))
        kind = pa.list_(pa.int64())
        others = [c for c in batch.schema.names if c != "ranges"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(starts, kind), pa.array(ends, kind), pa.array(kept, pa.binary())], [*others, "starts", "ends", "kept_bytes"])


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, the columns of ``docs`` in ``carry``, ``b`` (its UTF-8 bytes), ``starts, ends`` (of the maximal removed runs) and ``kept_bytes``.

    With ``whole_characters`` a run shrinks to the characters that lie in it, so that the kept bytes are valid UTF-8. Columns to carry must not be called like those above.

    A null text is empty. ``doc_id`` is an integer; a null id counts as the largest. Rows that repeat an id do not remove from each other. Texts
    under ``length`` bytes never change. An empty table gives an empty result.
    """
    assert length > GRAM
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id"), *carry, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), body.alias("b"))
    # Only repeated ids need their text's hash to tell their rows apart.
    repeats = not rows.groupBy("id").count().filter("count > 1").isEmpty()
    rows = rows.withColumn("t", F.xxhash64("b") if repeats else F.lit(0).cast("long"))
    heads = staged(rows.select("id", "t", F.sha2("b", 256).alias("sha"), F.octet_length("b").alias("n")), "heads")
    firsts = grouped(heads.filter(F.col("n") >= length), ["sha"], F.min("id").alias("first"), F.count("*").alias("c"))
    copies = heads.join(firsts.filter("c > 1").select("sha", "first"), "sha").filter("id > first").select("id", "t", "n").distinct()
    total = heads.agg(F.sum("n")).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, 2 * total / (length - GRAM + 2) / BUCKET)))))

    grams = staged(shared_grams(rows, bits, length), "grams")
    lists = grams.groupBy("id", "t").agg(F.collect_list("gram").alias("grams")).join(copies.select("id", "t"), ["id", "t"], "left_anti")
    segs = staged(segments(rows.select("id", "t", "b").join(lists, ["id", "t"]), length), "segments")
    discard(grams)
    digest = [F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(3), "seg").alias("s2")]
    distinct = staged(segs.groupBy("gram", "seg").agg(F.min("id").alias("first")).select("gram", "seg", *digest, "first"), "distinct")
    crowd = staged(distinct.groupBy("gram").agg(F.sum(F.octet_length("seg").cast("long")).alias("c")).filter(F.col("c") > HOT).select("gram"), "crowd")
    size = distinct.agg(F.sum(F.octet_length("seg").cast("long"))).first()[0] or 0
    shuffle = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    hot = distinct.join(crowd, "gram", "left_semi")
    verdicts = staged(block_verdicts(distinct.join(crowd, "gram", "left_anti"), length, shuffle).unionByName(hot_verdicts(hot, length)), "verdicts")
    discard(distinct, crowd)

    found = segs.select("id", "t", "start", "count", *digest).join(verdicts, ["s1", "s2"])
    whole = F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("count") + length - 1).alias("z")))
    parts = F.zip_with("offs", "lens", lambda o, n: F.struct((F.col("start") + o).alias("a"), (F.col("start") + o + n + length - 1).alias("z")))
    ranges = found.select("id", "t", F.when(F.col("id") > F.col("first"), whole).otherwise(parts).alias("r")).filter(F.size("r") > 0)
    gone = copies.select("id", "t", F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("z"))).alias("r"))
    merged = staged(ranges.unionByName(gone).groupBy("id", "t").agg(F.flatten(F.collect_list("r")).alias("ranges")), "ranges")
    discard(segs, verdicts, heads)
    out = rows.join(merged, ["id", "t"], "left").select("doc_id", *carry, "b", "ranges")
    schema = out.drop("ranges").schema
    for name, made in (("starts", ArrayType(LongType())), ("ends", ArrayType(LongType())), ("kept_bytes", BinaryType())):
        schema = schema.add(name, made)
    return out.mapInArrow(lambda batches: _cut(batches, whole_characters), schema)

