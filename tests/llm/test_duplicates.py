"""MinHash, suffix, embedding and archive operators against brute force."""

import gzip
import hashlib
import io
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.llm import minhash as M
from gridlake.llm import nn_descent as N
from gridlake.llm import suffix_dedup as S
from gridlake.llm import warc as A
from gridlake.llm.common import checkpointed, grouped
from gridlake.llm.components import components

DOCS = "doc_id long, text string, component long, bands string, t int, gram string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1, "g") for i, t in rows], DOCS)


class Union:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


# Components


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 430)] + [(500, 500)]
    u = Union({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# MinHash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def test_shingle_sets():
    rng = random.Random(2)
    texts = ["", " \t\n", "One two", "a b c d e", "a b c d e f", " x y", "é É", "w " * 100, "x" * 300_000 + " y z"] + [" ".join(rng.choice("abcde") for _ in range(rng.randrange(60))) for _ in range(50)]
    got = M.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in got] == [len(shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert len(np.intersect1d(got[i], got[j])) == len(shingles(a) & shingles(b))


def test_densified_bins():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 100, 5000):
        s = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        v = M.one_permutation(s)
        bins = s >> np.uint64(57)
        for b in set(bins.tolist()):
            assert v[b] == s[bins == b].min()
        assert np.isin(v, s).all()


def test_minhash(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, n = [], 0
    for _ in range(40):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((n, " ".join(copy)))
            n += 1
    hot = [word() for _ in range(120)]
    for _ in range(150):
        copy = list(hot)
        copy[rng.randrange(120)] = word()
        rows.append((n, "  ".join(copy).upper()))
        n += 1
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "one two three"), (906, "long " * 30_000), (903, "one two"), (None, "one two"), (907, "x y z w v")]
    sets = {i: shingles(t) for i, t in rows if i is not None}
    u = Union(sets)
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                    u.join(i, j)
    got = M.minhash_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert (r["component_id"], r["kept"]) == (None, False)
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), u.find(i), u.find(i) == i)
    assert M.minhash_dedup(docs(spark, [])).count() == 0


def test_minhash_outliers_of_a_large_group(spark):
    """Each outlier is near one member of a large group and far from the others, so stars do not meet the pair."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(404)]

    def changed(words, places):
        words = list(words)
        for k in places:
            words[k] = word()
        return words

    members = [changed(base, rng.sample(range(10, 200, 10), 2)) for _ in range(250)]
    outliers = [changed(members[k * 6], rng.sample(range(210, 400, 10), 5)) for k in range(40)]
    rows = [(1000 + i, " ".join(w)) for i, w in enumerate(members)] + [(i, " ".join(w)) for i, w in enumerate(outliers)]
    sets = {i: shingles(t) for i, t in rows}
    u, true = Union(sets), dict.fromkeys(range(40), 0)
    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and 100 * k >= 85 * (len(sets[i]) + len(sets[j]) - k):
                u.join(i, j)
                if i < 40:
                    true[i] += 1
    assert sum(1 <= n <= 3 for n in true.values()) >= 35
    got = {r["doc_id"]: r["component_id"] for r in M.minhash_dedup(docs(spark, rows)).collect()}
    assert got == {i: u.find(i) for i in sets}


def test_parities_bound_differences():
    rng = np.random.default_rng(5)
    for n in (0, 1, 50, 3000):
        x, y = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.concatenate([x[: n // 2], y]))
        assert np.bitwise_count(M.parities(x) ^ M.parities(y)).sum() <= len(np.setxor1d(x, y))


def test_minhash_repeated_ids_with_other_texts(spark):
    """Each text of an id links by its own set, and the rows of the id share the smallest component."""
    rng = random.Random(23)
    text = lambda: ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]

    def near(words):
        return [*words[:100], "changed", *words[101:]]

    p, q, r = text(), text(), text()
    rows = [(1, p), (1, q), (2, near(p)), (3, near(q)), (9, r), (4, near(r)), (9, near(q)), (7, text()), (7, text())]
    got = sorted((x["doc_id"], x["component_id"], x["kept"]) for x in M.minhash_dedup(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False), (7, 7, True), (7, 7, True), (9, 1, False), (9, 1, False)]


def test_hot_keys_are_split(spark):
    """A join of rows with an aggregate by the same key is split where a key is hot."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 60_000, 1, 8).selectExpr("if(id % 3 = 0, -1, id) AS k", "id")
        hot = rows.join(grouped(rows, ["k"], F.count("*").alias("n")), "k")
        assert hot.selectExpr("sum(n)").first()[0] == 20_000**2 + 40_000
        shown = hot.filter("n >= 0")
        shown.collect()
        assert "skew=true" in shown._jdf.queryExecution().executedPlan().toString()
        plain = rows.join(rows.groupBy("k").agg(F.count("*").alias("n")), "k").filter("n >= 0")
        plain.collect()
        assert "skew=true" not in plain._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_tables_of_iterations_stay_small_plans(spark):
    """Sizes that the planner assumes do not grow from step to step."""
    now = spark.range(100).selectExpr("id AS a", "id + 1 AS b")
    for _ in range(4):
        now = checkpointed(now.join(now.withColumnRenamed("b", "c"), "a").select("a", "b"))
    assert now._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 20


# Suffix dedup


def removed(rows, length=S.LENGTH):
    first, out = {}, []
    keyed = sorted(((i if i is not None else 1 << 63, k, (t or "").encode()) for k, (i, t) in enumerate(rows)))
    for i, _, b in keyed:
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, k, b in keyed:
        mark = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                mark[p] += 1
                mark[p + length] -= 1
        out.append((k, np.cumsum(mark)[: len(b)] > 0, b))
    return {k: (bytes(np.frombuffer(b, np.uint8)[~m]), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())) for k, m, b in out}


@pytest.mark.parametrize("size", [1, 2, 3, 7, 40, 400])
@pytest.mark.parametrize("symbols", [1, 2, 30])
def test_suffix_ranks(size, symbols):
    x = np.random.default_rng(size).integers(1, symbols + 1, size)
    order = sorted(range(size), key=lambda i: x[i:].tolist())
    want = np.empty(size, int)
    want[order] = np.arange(size)
    assert (S.suffix_ranks(x, size + 1) == want).all()
    by = np.argsort(S.suffix_ranks(x, 9), kind="stable")
    assert all(x[a : a + 9].tolist() <= x[b : b + 9].tolist() for a, b in zip(by, by[1:]))


def suffix_rows():
    rng = random.Random(5)
    text = lambda n, letters="abcdé \n": "".join(rng.choice(letters) for _ in range(n))
    passages = [text(n) for n in (30, 45, 60, 90, 500)]
    rows = []
    for i in range(120):
        parts = [text(rng.randrange(200))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages)[rng.randrange(20) :], text(rng.randrange(80))]
        rows.append((i * 3 % 127, "".join(parts)))
    near = text(800)
    for i in range(200, 230):
        at = rng.randrange(790)
        rows.append((i, near[:at] + "X" + near[at + 1 :]))
    rows += [(300, rows[3][1]), (301, rows[3][1]), (302, None), (303, ""), (304, "z" * 5000), (305, "z" * 70), (306, "short"), (307, "short"), (None, passages[4]), (308, "ab" * 900), (309, "ba" * 40), (310, passages[4]), (310, passages[4]), (311, "\U0001f642" * 40), (312, "x\U0001f642" * 3 + "\U0001f642" * 30)]
    return rows


@pytest.mark.parametrize("hot", [S.HOT, 3, 300])
def test_suffix_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK", 2000)
    monkeypatch.setattr(S, "BLOCK_BYTES", 3000)
    rows = suffix_rows()
    want = removed(rows)
    expected = sorted((str(i), hashlib.sha256(want[k][0]).hexdigest(), want[k][1]) for k, (i, _) in enumerate(rows))
    got = S.suffix_dedup(docs(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["kept_bytes"]).hexdigest(), len(r["starts"])) for r in got) == expected
    for r in got:
        b, kept = bytes(r["b"]), bytes(r["kept_bytes"])
        assert kept == b"".join(b[x:y] for x, y in zip([0, *r["ends"]], [*r["starts"], len(b)]))


def test_lone_segments_are_not_sorted(spark, monkeypatch):
    """A gram with one segment needs no sort; where grams meet batch and block edges, each segment still gets its verdict."""
    sort = S._block

    def block(segs, first, length):
        assert not any(s.startswith(b"lone") for s in segs)
        return sort(segs, first, length)

    monkeypatch.setattr(S, "_block", block)
    monkeypatch.setattr(S, "BLOCK_BYTES", 500)
    rng = random.Random(9)
    rows, want = [], {}
    for gram in range(300):
        body = bytes(rng.choices(b"abcd", k=60))
        mine = [b"lone" + body] if rng.random() < 0.6 else [bytes([65 + k]) + body for k in range(rng.randrange(2, 6))]
        for k, seg in enumerate(mine):
            want[len(rows)] = (k, [1] if k else [], [11] if k else [])
            rows.append((gram, seg, len(rows), 0, k))
    distinct = spark.createDataFrame(rows, "gram long, seg binary, s1 long, s2 long, first long")
    for parts in (1, 7):
        got = S.block_verdicts(distinct, 50, parts).collect()
        assert len(got) == len(rows) and {r["s1"]: (r["first"], r["offs"], r["lens"]) for r in got} == want


def test_suffix_whole_characters(spark):
    rows = suffix_rows()
    for r in S.suffix_dedup(docs(spark, rows), carry=("component",), whole_characters=True).collect():
        bytes(r["kept_bytes"]).decode()
    assert S.suffix_dedup(docs(spark, [])).count() == 0


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    vectors = []
    for label in (0, 1, 1, 2):
        for _ in range(60):
            vectors.append((rng.standard_normal(16), label))
        centre = rng.standard_normal(16)
        vectors += [(centre + 0.03 * rng.standard_normal(16), label) for _ in range(45)]
        vectors += [(centre, label)] * 12
    vectors += [(np.zeros(16), 0), (np.full(16, np.nan), 0), (np.r_[np.inf, np.zeros(15)], 1), (vectors[0][0], None)]
    rows = [(i * 7 % 1009, [float(np.float32(x)) for x in v], label, 1) for i, (v, label) in enumerate(vectors)]
    rows += [(2000, None, 0, 1), (2001, [], 0, 1), (2002, [None, *[1.0] * 15], 0, 1), (2003, [1.0, 2.0], 0, 1), (2004, [2.0, 4.0], 0, 1), (None, rows[0][1], 0, 1)]
    got = {r["vec_id"]: r for r in N.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int")).collect()}
    assert len(got) == len(rows)

    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v, float) / np.linalg.norm(np.array(v, float))

    units = [(i, unit(v), label) for i, v, label, _ in rows if i is not None]
    u, links = Union([i for i, *_ in units]), {i: 0 for i, *_ in units}
    for k, (i, a, x) in enumerate(units):
        for j, b, y in units[:k]:
            if x is not None and x == y and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.98:
                links[i] += 1
                links[j] += 1
                u.join(i, j)
    assert {i: got[i]["n_links"] for i in links} == links
    assert {i: got[i]["component_id"] for i in links} == {i: u.find(i) for i in links}
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert N.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def brute_links(rows, threshold=0.98):
    """Links and components of (id, vector, label) rows, in double."""
    units = []
    for i, v, label in rows:
        m = np.array(v, float)
        m = m / np.abs(m).max()
        units.append((i, m / np.linalg.norm(m), label))
    u, links = Union([i for i, *_ in units]), [0] * len(units)
    for k, (i, a, x) in enumerate(units):
        for j, (other, b, y) in enumerate(units[:k]):
            if x == y and len(a) == len(b) and a @ b >= threshold:
                links[k] += 1
                links[j] += 1
                u.join(i, other)
    return sorted((i, n, u.find(i)) for (i, *_), n in zip(units, links))


def test_embeddings_in_double_and_repeated_ids(spark):
    rng = np.random.default_rng(12)
    a, b = rng.standard_normal(8), rng.standard_normal(8)
    rows = [(1, [1e39, 0.0], 0), (2, [1e39, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1e200, 1e199], 0), (5, [1e-200, 0.0], 0)]
    rows += [(10, a.tolist(), 1), (11, b.tolist(), 1), (12, (a + 1e-3).tolist(), 1), (13, (b * 3).tolist(), 1), (10, b.tolist(), 1), (14, (a * 2).tolist(), 1), (10, a.tolist(), 1)]
    got = N.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)


@pytest.mark.parametrize("audits", [1, 3])
def test_embeddings_audits(spark, monkeypatch, audits):
    """Audits that draw too few, or fail, lead to further draws and orders, and in the end to the whole label."""
    for name, value in {"ORDERS": 1, "NEXT": 1, "MAX_ROUNDS": 1, "AUDIT": 30, "MORE": 2, "AUDITS": audits, "ENOUGH": 5, "SIDE": 100}.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(21)
    vectors = [rng.standard_normal(32) for _ in range(150)]
    vectors += [v + 0.1 * rng.standard_normal(32) for v in vectors[:60]]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    got = N.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)


def test_embeddings_dense_groups_with_a_bridge(spark, monkeypatch):
    """Lists are far shorter than the groups, and one vector links two of them."""
    monkeypatch.setattr(N, "K", 3)
    monkeypatch.setattr(N, "MOST", 8)
    monkeypatch.setattr(N, "FAR", 3)
    rng = np.random.default_rng(31)
    base = rng.standard_normal(64)
    base /= np.linalg.norm(base)
    side = rng.standard_normal(64)
    side -= (side @ base) * base
    side /= np.linalg.norm(side)
    at = lambda angle: np.cos(angle) * base + np.sin(angle) * side
    step = 0.9 * np.arccos(0.98)
    vectors = [at(0) + 0.004 * rng.standard_normal(64) for _ in range(120)] + [at(step)] + [at(2 * step) + 0.004 * rng.standard_normal(64) for _ in range(120)]
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate(vectors)]
    got = N.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute_links(rows)


def test_embeddings_isolated_pairs(spark, monkeypatch):
    """Rounds run out in a search too weak for isolated pairs, beside a group that has nearly all links; another label has no links."""
    monkeypatch.setattr(N, "ORDERS", 1)
    monkeypatch.setattr(N, "NEXT", 1)
    monkeypatch.setattr(N, "MAX_ROUNDS", 1)
    monkeypatch.setattr(N, "SIDE", 300, raising=False)
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(150):
        v = rng.standard_normal(64)
        vectors += [(v, 0), (v + 0.15 * rng.standard_normal(64), 0)]
    centre = rng.standard_normal(64)
    vectors += [(centre + 0.05 * rng.standard_normal(64), 0) for _ in range(200)] + [(rng.standard_normal(64), 0) for _ in range(400)]
    vectors += [(rng.standard_normal(64), 1) for _ in range(50)]
    m = np.array([v for v, _ in vectors], "<f4")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1)[:, None]
    label = np.array([x for _, x in vectors])
    near = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(m), dtype=bool)
    assert 100 < (near.sum(axis=1) == 1).sum() < 400
    rows = [(i, [float(x) for x in v], int(x)) for i, (v, x) in enumerate(zip(m, label))]
    got = {r["vec_id"]: r["n_links"] for r in N.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == dict(enumerate(near.sum(axis=1).tolist()))


# Archives


@pytest.mark.parametrize("version", [1, 2])
def test_arc_stream(version):
    head = A.arc_header(version, "f", "20200101000000")
    body = A.arc_record(version, "f", "http://a/", "20200102030405", b"payload\n\n", len(head))
    records = list(A.read_arc(io.BytesIO(head + body + b"\n" + body)))
    assert [(r["url"], r["date"], r["ip"]) for r in records] == [("http://a/", "20200102030405", "127.0.0.1")] * 2
    assert A.payload_of(records[0]["block"]) == b"payload\n\n" and records[0]["offset"] == len(head)
    made = [r for r in A.convert("f", io.BytesIO(head + body), {})]
    (headers, block), = A.read_warc(io.BytesIO(b"".join(made)))
    assert headers["warc-type"] == "response" and headers["warc-date"] == "2020-01-02T03:04:05Z"
    assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"payload\n\n").hexdigest()
    for bad in (body[:-20], head + b"http://x/ 1.2.3.4 nonsense\n", b"filedesc://f 0 0 text/plain 4\n9 0\n"):
        with pytest.raises(ValueError):
            list(A.read_arc(io.BytesIO(bad if bad is not body[:-20] else head + bad)))


@pytest.mark.parametrize(("arc", "iso"), [("20200102030405", "2020-01-02T03:04:05Z"), ("202001", "2020-01-01T00:00:00Z"), ("x", "1970-01-01T00:00:00Z"), ("20209999", "1970-01-01T00:00:00Z")])
def test_warc_date(arc, iso):
    assert A.warc_date(arc) == iso


@pytest.mark.parametrize("version", [1, 2])
def test_archive_pages(spark, version):
    big = "<html>" + "é" * 200
    html = [None, "", "x" * 99, "x" * 99, "y" * 100, "y" * 100, big, big, big, "HTTP/1.1 fake\r\n\r\nbody" * 9, "z" * 3_000_000]
    rows = [(50 - i, None if i == 3 else f"http://h/{i} a", h, "extra") for i, h in enumerate(html)] + [(-5, "u", big, "e"), (44, "again", big, "e")]
    got = A.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3), version=version).collect()
    first = {}
    for i, _, h, _ in sorted(rows):
        first.setdefault((h or ""), i)
    want = []
    seen = set()
    for i, _, h, _ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        b = (h or "").encode()
        again = len(b) >= 100 and h in seen
        seen.add(h)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    key = lambda r: (r[0], str(r[4]))
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert A.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_record_id_expression(spark):
    rows = [("arc-000001", 12, "http://h/é a", "ab" * 32), ("x", 0, "", "0"), ("y", 1 << 40, "u#row=~", "ff")]
    df = spark.createDataFrame(rows, "name string, offset long, url string, digest string")
    got = df.select("offset", A.record_id_column(*(F.col(c) for c in df.columns)).alias("id")).collect()
    assert {r["offset"]: r["id"] for r in got} == {r[1]: A.record_id(*r) for r in rows}


def test_archive_null_id(spark):
    got = A.archive_pages(spark.createDataFrame([(None, "u", "q" * 200), (3, "v", "q" * 200)], "page_id long, url string, html string")).collect()
    assert sorted([(r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in got]) == [(0, "revisit", 3), (3, "response", None)]


def test_gzip_members(tmp_path, spark):
    folder = f"file://{tmp_path}"
    A.archive_pages(spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string").coalesce(1), folder).count()
    (path,) = (tmp_path / "warc").glob("*.warc.gz")
    assert path.read_bytes().count(b"\x1f\x8b\x08") >= 5 and gzip.open(path).read().count(b"WARC/1.1") == 5
