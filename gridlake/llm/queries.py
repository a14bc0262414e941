"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_roundtrip
from .chat_format import chat_report
from .common import table
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .minhash import minhash_dedup
from .nn_descent import embedding_dedup
from .packing import best_fit_pack
from .quality import fit, held_out, score
from .suffix_dedup import suffix_dedup
from .warc import archive_pages


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_best_fit_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.octet_length("b").cast("long").alias("n_bytes"),
        (F.octet_length("b") - F.octet_length("kept_bytes")).cast("long").alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op4_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_roundtrip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT -7L AS conv_id, i AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(i, r)")
    return chat_report(turns.unionByName(more))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_best_fit_pack, op3_suffix_dedup, op4_arc_to_warc, op5_nn_descent, op6_bpe, op7_quality, op8_exact_dedup, op9_chat_format, op10_minhash)}

ORACLES = {
    "op1_line_dedup": r"""
with lines as (
  select d.rowid_ as r, doc_id, source, i, string_split(text, chr(10))[i] as line
  from (select *, row_number() over () as rowid_ from documents) d, unnest(range(1, len(string_split(text, chr(10))) + 1)) u(i)
), bad as (
  select trim(line, ' ') as norm from lines where length(trim(line, ' ')) >= 20 group by 1 having count(distinct source) >= 10
), marked as (
  select l.*, b.norm is not null as cut from lines l left join bad b on trim(l.line, ' ') = b.norm
)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where cut))::bigint as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not cut), '')) as text_sha256
from marked group by r, doc_id
union all
select doc_id, 0, 0, sha256('') from documents where text is null
""",
    "op4_arc_to_warc": r"""
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select *, min(page_id) over (partition by html) as first from p
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and first < page_id then first end as refers_to
from f
""",
    "op8_exact_dedup": r"""
with t as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
""",
    "op9_chat_format": r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, replace(replace(text, '&', '&amp;'), '<', '&lt;') as shown, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;') as shown_role,
         role = lag(role) over (partition by conv_id order by turn, role, text) as same
  from t
)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(shown) + case when same then 10 else 24 + length(shown_role) end)::bigint as formatted_chars
from e group by conv_id
""",
}
