"""BPE encoding and decoding by a pair occurrence index.

The distinct words of a part of a partition (all of it, up to ``PART`` bytes of text) are laid out as one list of symbols. An index maps each mergeable pair to all its
positions; the active ranks are taken in ascending order from a heap, and a merge at a position updates the lists of the pairs it
makes with its neighbours. Because every merge's parts are made by earlier merges (checked when the file is read), new pairs
rank later than the one in hand, and rank order over the whole list is the order within each word. Nothing is kept from one part to the next.

Normaliser and word pattern are the file's own. Texts in Latin script take these steps (NFC, lower case, the split pattern, the byte alphabet) here, if the
file has just these; all others go through the ``tokenizers`` library's.
No shuffle; memory is bounded by a part's texts, its distinct words and a number for each place of a word.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import byte_alphabet, slices

#: Bytes of texts whose words are encoded together.
PART = 12 << 20

# The steps that a file may state and that are taken here too.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


assert sys.byteorder == "little" and array("I").itemsize == 4  # ids leave as little-endian unsigned 32-bit numbers


class WordBpe:
    #: Characters whose class or case is left to the library.
    ODD = re.compile("[\x1c-\x1f\x85]|[^\x00-\u024f]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.library = Tokenizer.from_file(path)
        self.normalise, self.words_of = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        self.vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.token = {i: s for s, i in self.vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rank: dict[tuple[int, int], int] = {}
        self.merge: list[tuple[int, int, int]] = []
        made: dict[int, int] = {}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if max(made.get(x, -1), made.get(y, -1)) >= len(self.merge) or z in made:
                raise ValueError("merges whose parts come later, or twice, are not supported")
            made[z] = len(self.merge)
            self.rank[x, y] = len(self.merge)
            self.merge.append((x, y, z))
        split, *more = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        plain = [{"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        usual = (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and more == plain
        usual = usual and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        self.find = regex.compile(PATTERN).findall if usual else None
        self.shown = {b: c for c, b in byte_alphabet().items()}

    def _words(self, text: str) -> list[str] | None:
        """Words of a text in lower case, found here; None if that is the library's to do."""
        if self.find is None or self.ODD.search(text) or any(t in text for t in self.special):
            return None
        return self.find(text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower())

    def _in_bytes(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word  # a visible ASCII character stands for itself
        return word.encode().decode("latin-1").translate(self.shown)

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (in the byte alphabet) by the pair occurrence index over all of them."""
        rank_of, merge, vocab = self.rank.get, self.merge, self.vocab
        sym: list[int] = []
        first = []
        for w in words:
            first.append(len(sym))
            marks = [*w[:-1], w[-1] + self.suffix] if w else []
            sym.extend(vocab[s] for s in marks if s in vocab)
            sym.append(-1)  # no pair reaches over a word's end
        after = list(range(1, len(sym) + 1))
        before = list(range(-1, len(sym) - 1))
        places: dict[int, list[int]] = defaultdict(list)
        for p in range(len(sym) - 1):
            r = rank_of((sym[p], sym[p + 1]))
            if r is not None:
                places[r].append(p)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            left, right, joined = merge[r]
            for p in sorted(places.pop(r)):
                q = after[p]
                if sym[p] != left or sym[q] != right:
                    continue  # an earlier merge took one of the two
                sym[p], sym[q] = joined, -2
                n, b = after[q], before[p]
                after[p], before[n] = n, p
                for at, pair in ((p, (joined, sym[n])), (b, (sym[b], joined) if b >= 0 else None)):
                    if pair is not None and (k := rank_of(pair)) is not None:
                        if k not in places:
                            heapq.heappush(active, k)
                        places[k].append(at)
        out = []
        for p in first:
            ids = []
            while sym[p] != -1:
                ids.append(sym[p])
                p = after[p]
            out.append(ids)
        return out

    def _plan(self, text: str, number: dict) -> array:
        """The numbers of a text's words, of which new ones get the next; words of the library and added tokens are keyed by a pair."""
        put = number.setdefault
        words = self._words(text)
        if words is None:
            words = []
            for part in self.cut.split(text) if self.cut else [text]:
                if part in self.special:
                    words.append(("token", part))
                elif part:
                    words += [("shown", w) for w, _ in self.words_of(self.normalise(part))]
        return array("I", [put(w, len(number)) for w in words])

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids, decoded) of each text."""
        number: dict = {}
        plans = [self._plan(t, number) for t in texts]
        tokens = {n: w[1] for w, n in number.items() if isinstance(w, tuple) and w[0] == "token"}
        shown = ["" if n in tokens else w[1] if isinstance(w, tuple) else self._in_bytes(w) for w, n in number.items()]
        ids, said = [], []
        for n, found in enumerate(self.merge_words(shown)):
            found = [self.special[tokens[n]]] if n in tokens else found
            ids.append(array("I", found).tobytes())
            said.append(" ".join([self.token[i] for i in found]))
        return [(b"".join([ids[n] for n in p]), " ".join([x for n in p if (x := said[n])])) for p in plans]


def parts(batches: Iterator[pa.RecordBatch], column: str, size: int = PART) -> Iterator[pa.RecordBatch]:
    """Batches in which ``column`` holds about ``size`` bytes: larger ones cut, smaller ones joined."""
    held, bytes_held = [], 0
    for b in slices(batches, column, size):
        n = b.column(column).nbytes
        if held and bytes_held + n > size:
            yield pa.concat_batches(held)
            held, bytes_held = [], 0
        held.append(b)
        bytes_held += n
    if held:
        yield pa.concat_batches(held)


@functools.cache
def bpe(path: str) -> WordBpe:
    """One per worker."""
    return WordBpe(path)


def bpe_roundtrip(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``doc_id, ids, decoded`` of every text: its ids (little-endian unsigned 32-bit) and their decoded text.

    Equal to the ``tokenizers`` library's ``encode(text, add_special_tokens=False)`` without truncation or padding, and ``decode(ids,
    skip_special_tokens=False)`` of a file without a decoder. A null text is the empty one: no ids, empty decoded text. One row per row, in any order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(tokenizer)
        for batch in parts(batches, "text"):
            out = model.encode_batch([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
