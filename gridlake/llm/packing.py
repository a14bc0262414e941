"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Two steps. ``tokenise`` turns texts into pieces of at most ``capacity`` tokens; ``pack`` places the pieces. Packing is dealt into
groups of a bounded number of pieces (by a hash of the piece's number, so no key can make a group large), and each group is packed by
best-fit decreasing: a segment tree over the remaining capacities 0..capacity counts the open bins, and the
tightest open bin for a piece is found in O(log capacity). Groups leave at most a few bins unfilled each, one in some thousands.
Full pieces need no bin of others and get a sequence each without a shuffle.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

CAPACITY = 1024
END_ID = 2
GROUP_PIECES = 16384
#: Entries of a worker's cache of encoded text chunks.
CACHE = 200_000
SLICE_BYTES = 8 << 20


@functools.cache
def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpeEncoder:
    """Ids of a byte-level BPE file (``tokenizers`` JSON), equal to ``encode(text, add_special_tokens=False)``.

    Texts are cut where the split pattern always cuts, before a single blank or line feed between visible characters, and the chunks'
    ids are cached. Chunks in Latin script are encoded by ``tiktoken`` from the same vocabulary, others, and texts that hold an added token, by ``tokenizers``.
    """

    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
    ODD = re.compile("[^\x00-ɏ]")
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        alphabet = byte_alphabet()
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(alphabet[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.after: dict[str, bytes] = {}  # by what follows a blank, or by a line feed and what follows it
        self.as_is: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, chunk: str) -> bytes:
        if self.ODD.search(chunk):
            return self._library(chunk)
        return np.array(self.fast.encode_ordinary(chunk), "<u4").tobytes()

    def _cached(self, chunk: str) -> bytes:
        got = self.as_is.get(chunk)
        if got is None:
            got = self._encode(chunk)
            if len(self.as_is) < CACHE and len(chunk) < 64:
                self.as_is[chunk] = got
        return got

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._library(text)
        parts = text.replace("\n", " \n").split(" ")
        get = self.after.get
        out = [get(p) for p in parts]
        out[0] = self._cached(parts[0]) if parts[0] else b""
        if not parts[0] and len(parts) > 1 or parts[0] != parts[0].strip():
            return b"".join(map(self._cached, self.CUT.split(text)))
        for i, got in enumerate(out):
            if got is None:
                p = parts[i]
                seen = p[1:] if p[:1] == "\n" else p
                if not seen or seen[0].isspace() or seen[-1].isspace():  # runs of white space: cut more carefully
                    return b"".join(map(self._cached, self.CUT.split(text)))
                out[i] = self._encode(p if p[0] == "\n" else " " + p)
                if len(self.after) < CACHE and len(p) < 64:
                    self.after[p] = out[i]
        return b"".join(out)


@functools.cache
def encoder(path: str) -> ByteBpeEncoder:
    """One per worker, with its cache."""
    return ByteBpeEncoder(path)


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` holds about ``size`` bytes in each."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * size / max(1, batch.column(column).nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """Pieces of all texts: ``doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit).

    A document's ids are its text's, then ``end_id``; a null text is the empty one. Longer ones are cut into pieces of
    ``capacity`` ids, of which only the first may be shorter. Repeated rows are packed each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text"):
            owner, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                all_ids = encode(t or "") + end
                n = len(all_ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(all_ids[4 * a : 4 * b])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


class OpenBins:
    """A segment tree over remaining capacities: leaf c counts the open bins with room for exactly c more."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        at = self.size + room
        while at:
            self.tree[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) of the tightest bin with room for ``need``."""
        tree, at = self.tree, self.size + need
        if not tree[at]:
            while at > 1 and (at & 1 or not tree[at + 1]):  # up to the first subtree on the right that holds a bin
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            tree[at] -= 1
            at >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins, made = OpenBins(capacity), 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = sizes[i]
        got = open_bins.take(n)
        if got is None:
            got, made = (capacity, made), made + 1
        room, b = got
        bin_of[i], offset[i] = b, capacity - room
        if room > n:
            open_bins.add(room - n, b)
    return bin_of, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (any columns, ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces of a sequence have gapless offsets from 0 and total at most ``capacity``. Each row is placed once. A table without rows gives none.
    """
    pieces = staged(pieces.withColumn("_piece", F.monotonically_increasing_id()), "pieces")
    full = pieces.filter(F.col("length") >= capacity)
    short = pieces.filter(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_pieces))
    dealt = short.select("_piece", "length", F.pmod(F.xxhash64("_piece"), F.lit(groups)).alias("_group"))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_piece"], ascending=[False, True])
        b, at = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        return pd.DataFrame({"_piece": rows["_piece"], "sequence_id": (int(key[0]) << 32) + b, "offset": at})

    placed = dealt.groupBy("_group").applyInPandas(place, "_piece long, sequence_id long, offset long")
    return (
        short.join(placed, "_piece")
        .unionByName(full.withColumn("sequence_id", -1 - F.col("_piece")).withColumn("offset", F.lit(0).cast("long")))
        .drop("_piece")
    )




def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all documents' pieces; ids travel as a checksum."""
    pieces = tokenise(docs, tokenizer, capacity, end_id, text)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)
