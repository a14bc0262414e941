"""The pipeline against its stages in plain Python."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridlake.llm import quality as Q
from gridlake.llm.queries import tokenizer_path

from .test_duplicates import Union, removed, shingles
from .test_text_operators import _prose, plain_best_fit


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    passage = " ".join("".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(30))
    notice = "this notice stands on every site of the corpus"
    rows = []
    for i in range(240):
        text = _prose(rng, 0 if i % 6 else 4 + i % 4)
        if i % 5 == 1:
            text += "\n" + notice
        if i % 11 == 1:
            text += "\n" + passage
        rows.append((i, text, "en", f"site{i % 15}", len(text)))
    for i in range(240, 250):
        words = rows[i - 239][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), "en", "copy", 1))
    rows += [(260, rows[7][1], "en", "copy", 1), (261, None, "en", "odd", None), (262, "", None, None, 0), (263, "Größe " * 60, "de", "odd", 9)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 6 != 0), 0) for i in range(0, 240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def test_pipeline(spark, folder):
    path, rows = folder
    model = Q.fit(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    score = Q.score_features(Q.features([(t or "").encode() for _, t, *_ in rows]), model)
    docs = [(i, t, s) for (i, t, _, s, _), x in zip(rows, score) if x >= Q.THRESHOLD]
    assert 150 < len(docs) < len(rows)
    sites = {}
    for _, t, s in docs:
        for line in (t or "").split("\n"):
            if s is not None and len(line.strip(" ")) >= 20:
                sites.setdefault(line.strip(" "), set()).add(s)
    bad = {x for x, s in sites.items() if len(s) >= 10}
    assert bad
    docs = [(i, None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in bad)) for i, t, _ in docs]
    sets = {i: shingles(t) for i, t in docs}
    u = Union(sets)
    for i in sets:
        for j in sets:
            k = len(sets[i] & sets[j])
            if i < j and k and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                u.join(i, j)
    docs = [(i, t) for i, t in docs if u.find(i) == i]
    cut = removed(docs)

    out = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, out, path)
        assert got.columns == out.columns, name
        out = got
    kept = {r["doc_id"]: r for r in out.collect()}
    assert set(kept) == {i for i, _ in docs}
    for k, (i, t) in enumerate(docs):
        assert kept[i]["text"] == cut[k][0].decode(errors="replace") or not (t or "").isascii()
        assert kept[i]["n_chars"] == len(kept[i]["text"])
    assert sum(len(t or "") for _, t in docs) > sum(len(r["text"]) for r in kept.values())

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = []
    for i, r in kept.items():
        ids = [*library.encode(r["text"], add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    packed = P.run(spark, path).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == sorted(want)
    assert len({r["sequence_id"] for r in packed}) == len(plain_best_fit([n for *_, n, _ in want], 1024))


def test_near_duplicates_from_80_percent(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(404)]
    copy = list(base)
    for k in range(10, 330, 40):
        copy[k] = "changed" + str(k)
    rows = [(1, " ".join(base)), (2, " ".join(copy))]
    a, b = (shingles(t) for _, t in rows)
    assert 80 <= 100 * len(a & b) / len(a | b) < 85
    got = P.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert [r["doc_id"] for r in got] == [1]


def test_clashing_columns_are_kept(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    more = {"score": 0.123, "Predicted": 7, "_": "under", "_others": "o", "starts": 3, "b": "b", "_key": 1, "n_removed": "n"}
    for name, value in more.items():
        docs = docs.withColumn(name, F.lit(value))
    docs = docs.limit(60)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert {c: r[c] for c in more} == more, name
    assert P.packing(spark, docs, path).count() >= 60


def test_empty_documents(spark, folder, tmp_path):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").filter("false")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.count() == 0, name
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
