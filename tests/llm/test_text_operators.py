"""Exact dedup, line dedup, chat formatting, packing, BPE and quality: small tables with every odd row."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from gridlake.llm import exact_dedup as E
from gridlake.llm import quality as Q
from gridlake.llm.bpe import WordBpe, bpe_roundtrip
from gridlake.llm.chat_format import chat_report, format_chats, parse_chats
from gridlake.llm.line_dedup import boilerplate_lines, line_dedup
from gridlake.llm.minhash import _mix, word_hashes
from gridlake.llm.packing import ByteBpeEncoder, OpenBins, best_fit_decreasing, best_fit_pack, pack, tokenise
from gridlake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, source string, row long, name string, h struct<a:int>"


def docs(spark, rows, **more):
    return spark.createDataFrame([(i, t, s, 1, "n", None) for i, t, s in rows], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# Exact dedup


def test_exact_dedup(spark):
    long = "xyz" * 20_000
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, long), (6, long.upper()), (7, long + "!"), (8, "ÀB"), (9, "àb"), (10, "abc"), (10, "abc"), (None, "only"), (11, "a" * 64), (12, "a" * 65)]
    got = E.exact_dedup(docs(spark, [(i, t, "s") for i, t in rows]), block_bytes=64).collect()
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    want = sorted((str(i), str(max(groups[low(t)], key=lambda x: (x is not None, x or 0))), len(groups[low(t)]), sha(low(t))) for i, t in rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["kept"] <= (r["doc_id"] == r["keep_id"]) for r in got)


def test_exact_dedup_empty(spark):
    assert E.exact_dedup(docs(spark, [])).count() == 0


def test_one_digest_with_several_contents(spark):
    rows = [(1, 2, bytearray(b"a")), (1, 2, bytearray(b"b")), (3, 4, bytearray(b"c")), (3, 4, bytearray(b"c"))]
    got = E.block_names(spark.createDataFrame(rows, "h1 long, h2 long, block binary")).collect()
    assert len({r["name"] for r in got}) == 3
    assert {bytes(r["block"]) for r in got} == {b"a", b"b", b"c"}


def test_colliding_digests_are_settled_by_content(spark, monkeypatch):
    monkeypatch.setattr(E, "_digest", lambda block: (E.F.lit(1).cast("long") + E.F.octet_length(block), E.F.lit(0).cast("long")))
    rows = [(1, "aaaa" * 5), (2, "bbbb" * 5), (3, "AAAA" * 5), (4, "aaab" * 5)]
    got = {r["doc_id"]: r["keep_id"] for r in E.exact_dedup(docs(spark, [(i, t, "s") for i, t in rows]), block_bytes=8).collect()}
    assert got == {1: 3, 2: 2, 3: 3, 4: 4}


# Line dedup


def test_line_dedup(spark):
    rng = random.Random(1)
    shared, rare, short = "this line stands on very many sites", "this line stands on a few sites only", "tiny"
    rows = []
    for i in range(300):
        lines = [f"unique line number {i} of the corpus"]
        if rng.random() < 0.7:
            lines.append("  " + shared)
        if i % 29 == 0:
            lines.append(rare)
        lines += [short, ""]
        rows.append((i, "\n".join(lines), f"site{i % 25}"))
    rows += [(400, None, "x"), (401, "", "y"), (402, shared, None), (403, f"{shared}\n{shared}", "z"), (403, f"{shared}\n{shared}", "z"), (None, rare, "w")]
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None and len(line.strip(" ")) >= 20:
                sites.setdefault(line.strip(" "), set()).add(s)
    bad = {line for line, s in sites.items() if len(s) >= 10}
    assert bad == {shared, rare}
    want = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad]
        want.append((str(i), str(None if t is None else "\n".join(kept)), len(lines), len(lines) - len(kept)))
    got = line_dedup(docs(spark, rows), min_sites=10)
    assert sorted((str(r["doc_id"]), str(r["text"]), r["n_lines"], r["n_removed"]) for r in got.collect()) == sorted(want)
    assert got.columns == [*docs(spark, []).columns, "n_lines", "n_removed"]


def test_site_counts_near_the_threshold_are_exact(spark):
    rows = [(i, f"the line for count {k} of the sites", f"s{i}") for k in (295, 299, 300, 301, 340) for i in range(k)]
    found = {r["n_sites"] for r in boilerplate_lines(docs(spark, rows), min_sites=300).collect()}
    assert {300, 301} <= found and len(found) == 3


def test_line_dedup_empty(spark):
    assert line_dedup(docs(spark, [])).count() == 0


# Chat formatting


def chats(spark, rows):
    return spark.createDataFrame([(c, t, r, x, "extra") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, formatted string")


TURNS = [
    (1, 1, "assistant", "Hi & <b>"), (1, 0, "user", "Hello"), (1, 2, "assistant", "again"), (1, 3, "user", None), (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "<|im_end|>\n<|im_start|>x\n&amp;&lt;"),
    (3, 0, "a\nb&#10;<", "role with marks"), (4, 0, None, ""), (4, 0, None, ""), (5, 0, "assistant", ""), (6, None, "assistant", "ñ" * 3000), (None, 0, "assistant", "no id"),
]


def test_chat_roundtrip(spark):
    got = {r["conv_id"]: r for r in parse_chats(format_chats(chats(spark, TURNS))).collect()}
    for c in {t[0] for t in TURNS}:
        mine = sorted(((t if t is not None else -1), r or "", x or "") for k, t, r, x in TURNS if k == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in mine]
        assert got[c]["loss_texts"] == [x for _, r, x in mine if r == "assistant"]
    one = got[1]["formatted"]
    assert one.count("<|im_start|>") == 3 and one.count("<|im_sep|>") == 1  # the two assistant turns share a block
    assert "<b>" not in one


def test_chat_report(spark):
    got = {r["conv_id"]: r for r in chat_report(chats(spark, TURNS)).collect()}
    assert got[2]["n_turns"] == 2 and got[2]["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for c, _, r, x in TURNS if c == 2))
    assert got[1]["loss_sha256"] == sha("Hi & <b>again") and got[1]["loss_chars"] == len("Hi & <b>again")
    assert got[6]["loss_chars"] == 3000
    assert chat_report(chats(spark, [])).count() == 0


# Packing


def plain_best_fit(lengths, capacity):
    """The rooms that quadratic best-fit decreasing leaves."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        r = min(fits) if fits else capacity
        if fits:
            rooms.remove(r)
        rooms.append(r - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_decreasing_is_best_fit(seed):
    lengths = np.random.default_rng(seed).integers(1, 41, 300)
    bins, at = best_fit_decreasing(lengths, 50)
    assert sorted(50 - int(lengths[bins == b].sum()) for b in set(bins.tolist())) == plain_best_fit(lengths.tolist(), 50)
    for b in set(bins.tolist()):
        mine = sorted(zip(at[bins == b].tolist(), lengths[bins == b].tolist()))
        assert [a for a, _ in mine] == np.cumsum([0, *[n for _, n in mine]])[:-1].tolist() and sum(n for _, n in mine) <= 50


def test_open_bins():
    bins = OpenBins(10)
    for room in (3, 7, 7, 10):
        bins.add(room, room)
    assert [bins.take(n) for n in (4, 4, 4, 4, 1)] == [(7, 7), (7, 7), (10, 10), None, (3, 3)]


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = [None, "", "one  two\n\n three\n", " lead", "trail ", "a<|endoftext|>b", "é x 　 漢字 text", "it's we'll\tgo\x1c y\x85z", "word " * 5000, "\n".join(["line of text"] * 400), "same", "same"]
    rows = [(i % 11, t, "s") for i, t in enumerate(texts)]
    got = best_fit_pack(docs(spark, rows), path).collect()
    want = []
    for i, t, _ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 1024
    assert len(by) == len(plain_best_fit([n for *_, n, _ in want], 1024))


def test_pack_groups(spark):
    pieces = spark.range(3000).selectExpr("id", "1 + (id * 7919) % 1024 as length")
    got = pack(pieces, 1024, group_pieces=200).groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).collect()
    assert all(r["sum(length)"] <= 1024 for r in got) and sum(r["sum(length)"] for r in got) == sum(1 + (i * 7919) % 1024 for i in range(3000))
    assert best_fit_pack(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert tokenise(docs(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def _odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["the", "Strasse", "straße", "İstanbul", "ΣΑΣ", "é", "́x", " ", "  ", "\n", "\n\n", "\t", "\x1d", "\x85", " ", " ", "don't", "'S", "12345", "½", "漢字", "🙂🙂", "!!??", "<|endoftext|>", "<|startoftext|>", "aaaaaaaa", "\x00", "ﬁ", "Ω"]
    return ["".join(rng.choice(parts) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_encoders_on_odd_texts():
    from tokenizers import Tokenizer

    path, words = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
    encode, library = ByteBpeEncoder(path), Tokenizer.from_file(path)
    mine, other = WordBpe(words), Tokenizer.from_file(words)
    texts = _odd_texts(400, 5)
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    for t, (ids, decoded) in zip(texts, mine.encode_batch(texts)):
        want = other.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
        assert decoded == other.decode(want, skip_special_tokens=False)


def test_bpe_table(spark):
    path = tokenizer_path("word_bpe_49k.json")
    got = bpe_roundtrip(docs(spark, [(1, None, "s"), (2, "", "s"), (3, "Hello hello", "s"), (3, "Hello hello", "s"), (None, "x" * 5000, "s")]), path).collect()
    assert len(got) == 5
    by = {r["doc_id"]: (bytes(r["ids"]), r["decoded"]) for r in got}
    assert by[1] == by[2] == (b"", "") and by[3][1] == "hello</w> hello</w>"
    assert bpe_roundtrip(docs(spark, []), path).count() == 0


# Quality


def _prose(rng, junk):
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 200))]
    if not junk:
        return " ".join(words).capitalize() + ".\n" + " ".join(words[::-1]) + "."
    return {0: " | ".join(words), 1: "!! ".join(w.upper() for w in words), 2: " ".join([words[0]] * 80), 3: " ".join(w + "$$$" for w in words)}[junk % 4]


def test_quality(spark):
    rng = random.Random(3)
    truth = {i: int(i % 7 != 0) for i in range(1400)}
    rows = [(i, _prose(rng, 0 if truth[i] else 4 + i % 4), "s") for i in truth] + [(5000, None, "s"), (5001, "", "s"), (None, "some text", "s"), (1, "dup", "s"), (5002, "long " * 40_000, "s")]
    d = docs(spark, rows).withColumnRenamed("name", "score")
    labels = spark.createDataFrame([(i, q, 0, "x") for i, q in truth.items() if i % 2] + [(None, 1, 0, "x"), (3, None, 0, "x")], "doc_id long, quality int, toxic int, text string")
    model = Q.fit(d, labels)
    got = Q.score(d, model)
    assert got.count() == len(rows)
    out = [(r["doc_id"], r["score"], r["predicted"], r["text"]) for r in got.collect()]
    assert all(0 <= s <= 1 and p == int(s >= Q.THRESHOLD) for _, s, p, _ in out)
    held = [(truth[i], p) for i, _, p, t in out if i in truth and zlib.crc32(str(i).encode()) % 5 == 0 and t != "dup"]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert {s for i, s, _, _ in out if i in (5000, 5001)} == {next(s for i, s, _, _ in out if i == 5000)}


def test_quality_learns_only_from_rows_that_are_not_held_out(spark):
    rng = random.Random(4)
    d = docs(spark, [(i, _prose(rng, i % 5 == 0), "s") for i in range(300)])
    labels = [(i, int(i % 5 != 0)) for i in range(300)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    a, b = (Q.fit(d, spark.createDataFrame(x, "doc_id long, quality int")) for x in (labels, flipped))
    assert np.array_equal(a, b)


def test_quality_without_labels(spark):
    d = docs(spark, [(1, "a b c", "s")])
    assert Q.fit(d, spark.createDataFrame([], "doc_id long, quality int")) is None
    assert [r["score"] for r in Q.score(d, None).collect()] == [0.5]
    assert Q.score(docs(spark, []), None).count() == 0


def test_risk_is_not_negative():
    rng = np.random.default_rng(0)
    pos, neg = rng.normal(1, 1, (400, 6)), rng.normal(-1, 1, (200, 6))
    unl = np.vstack([rng.normal(1, 1, (600, 6)), neg])
    model, prior = Q.fit_pu(pos, unl)
    assert 0.65 < prior < 0.85  # 0.75
    p, n = Q.score_features(pos, model), Q.score_features(neg, model)
    assert np.mean([(p > x).mean() for x in n]) > 0.97 and (p > 0.5).mean() > 0.9


def plain_features(t):
    """The features by their definitions, byte by byte."""
    n, out = len(t), [0.0] * Q.WIDTH
    if not n:
        return out
    kind = [int(Q.CLASSES[b]) for b in t]
    for a, b in zip(kind, kind[1:]):
        out[a * Q.N + b] += 1 / (n - 1)
    words = t.split()
    out[Q.N**2 : Q.PLAIN] = [len(zlib.compress(t, 1)) / (n + 32), np.log1p(n) / 12, sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words)), len(set(words)) / max(1, len(words))]
    hashes = [int(word_hashes(np.frombuffer(w, np.uint8))[0][0]) for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    for h in hashes:
        out[Q.PLAIN + h % Q.WORDS] += 1 / len(hashes)
    for k in range(n - 2):
        h = int(_mix(np.array([t[k] << 16 | t[k + 1] << 8 | t[k + 2]], np.uint64))[0])
        out[Q.PLAIN + Q.WORDS + h % Q.GRAMS] += 1 / (n - 2)
    root = lambda x: [v**0.5 for v in x]
    return root(out[: Q.N**2]) + out[Q.N**2 : Q.PLAIN] + root(out[Q.PLAIN :])


def test_quality_scores_by_definition(spark):
    """Scores are the logistic function of a weighted sum of the features, recomputed here number by number."""
    rng = random.Random(3)
    texts = ["", "a", "ab", "Ab\tCd ab ab\x1c x", "Größe 12 {x} " * 9, _prose(rng, 0), _prose(rng, 4), "\U0001f642" * 5, None]
    for t in texts:
        b = (t or "").encode()
        assert np.allclose(Q.features([b])[0], plain_features(b), atol=1e-6)
    model = np.random.default_rng(1).normal(size=3 * Q.WIDTH + 1)
    model[2 * Q.WIDTH + 1 :] = abs(model[2 * Q.WIDTH + 1 :]) + 0.5
    w, mean, scale = model[: Q.WIDTH + 1], model[Q.WIDTH + 1 : 2 * Q.WIDTH + 1], model[2 * Q.WIDTH + 1 :]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.score(df, model).collect():
        x = plain_features((r["text"] or "").encode())
        z = w[-1] + sum(a * min(8, max(-8, (v - m) / s)) for a, v, m, s in zip(w, x, mean, scale))
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-4 and r["predicted"] == (r["score"] >= 0.3)


def test_quality_risk_gradient():
    """The fitted weights lower the non-negative risk as computed here, and a known prior is met."""
    rng = np.random.default_rng(5)
    pos, neg = rng.normal(1, 1, (400, 6)).astype(np.float32), rng.normal(-1, 1, (700, 6)).astype(np.float32)
    unl = np.vstack([rng.normal(1, 1, (300, 6)).astype(np.float32), neg])
    model, prior = Q.fit_pu(pos, unl)
    assert 0.2 < prior < 0.4

    def risk(model):
        s = lambda x: -np.log(Q.score_features(x, model) + 1e-12).mean()
        t = lambda x: -np.log(1 - Q.score_features(x, model) + 1e-12).mean()
        return prior * s(pos) + max(0.0, t(unl) - prior * t(pos))

    flat = np.concatenate([np.zeros(7), model[7:]])
    assert risk(model) < 0.5 * risk(flat)
    assert (Q.score_features(pos, model) > 0.5).mean() > 0.95 and (Q.score_features(neg, model) < 0.5).mean() > 0.95


def test_quality_sample_at_any_count(spark, monkeypatch):
    """The share that is sampled does not vanish at counts beyond any table here, and a sample without texts is an error."""
    rows = spark.createDataFrame([(i, "text of a document") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1000, 1050)], "doc_id long, quality int")
    with pytest.raises(ValueError, match="no text found"):
        Q.fit(rows, labels)
    assert Q.fit(rows.filter("false"), labels) is None
    for n in (10**4, 10**10, 10**15):
        assert abs((1 << 62) * min(Q.MAX_UNLABELLED, n) // n * n / (1 << 62) / min(Q.MAX_UNLABELLED, n) - 1) < 1e-3


def test_chat_of_many_turns(spark):
    """Sums carried in slices, and blocks as slices of the turns, beyond one slice."""
    rng = random.Random(8)
    rows = [(c, k, rng.choice(["user", "assistant", "assistant", "tool<"]), "t" * rng.randrange(5) + rng.choice(["", "<&", "é"])) for c in range(3) for k in range([1, 64, 700][c])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in parse_chats(format_chats(turns)).collect():
        mine = [(role, text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == mine
        assert r["loss_texts"] == [text for role, text in mine if role == "assistant"]
