"""A corpus pipeline of five stages; each takes and (but for the last) returns documents.

quality classifier -> line dedup -> MinHash near-dedup -> suffix-array dedup -> best-fit packing
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.llm.common import fresh, staged, table
from gridlake.llm.line_dedup import line_dedup
from gridlake.llm.minhash import minhash_dedup
from gridlake.llm.packing import best_fit_pack
from gridlake.llm.quality import fit, score
from gridlake.llm.queries import tokenizer_path
from gridlake.llm.suffix_dedup import suffix_dedup


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; the others go.

    Rows that repeat an id or a text are judged each; a null text counts as empty. Without positive labels, all stay. Columns called like the model's
    own are kept. An empty table stays empty.
    """
    names = fresh(docs, "score", "predicted")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), names=tuple(names))
    return scored.filter(F.col(names[1]) == 1).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share. All rows stay, repeated ones and null texts too, and an empty table stays empty."""
    return _recounted(line_dedup(docs).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group.

    Rows without an id stay, as do all rows of an id that stays; of copies (equal sets of shingles) that with the smallest id stays. Texts without words, empty or null, are
    copies of nothing. An empty table stays empty.
    """
    gone = minhash_dedup(docs, percent=80).filter("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has, cut at whole characters.

    All rows stay; what is left of a text can be empty, a null text becomes the empty one, and rows that repeat an id do not remove from each other. An empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = docs.select("doc_id", "text", F.struct(F.lit(0).alias(*fresh(docs, "_")), *others).alias("_others"))
    out = suffix_dedup(held, carry=("_others",), whole_characters=True)
    text = F.col("kept_bytes").cast("string").alias("text")
    return _recounted(out.select(*(c if c == "doc_id" else text if c == "text" else F.col("_others")[c].alias(c) for c in docs.columns)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences."""
    return best_fit_pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", passages),
    ("best-fit packing", packing),
]

#: SQL cannot express a fitted classifier or a packing; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each result written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
