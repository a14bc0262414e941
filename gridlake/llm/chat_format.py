"""Chat formatting in Spark expressions only.

Turns of a conversation are collected as structs, sorted, adjacent turns of one role are merged by an
array aggregation, and the text is concatenated:

    <|im_start|>ROLE\\nTEXT[<|im_sep|>TEXT ...]<|im_end|>\\n ...

Inside texts and roles ``&`` becomes ``&amp;`` and ``<`` becomes ``&lt;`` (in roles a line feed also
becomes ``&#10;``), so that ``<`` starts a control string and nothing else: whatever a user typed,
the output parses back to the turns it was made of. The loss mask is a list of code-point
spans that hold the escaped texts of the trained role, and no markup.

Rows and bounds: one conversation becomes one row, as the format demands, so the turns of one
conversation meet in one task; conversations are spread by ``conv_id``. Whole conversations that
are repeated need no special care, since each has an id of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def running(lengths: Column) -> Column:
    """For each of ``lengths`` (longs) the sum of those before it. Sums are carried in slices, as growing one array number by number copies it each time."""
    n = 64
    zero = F.lit(0).cast("long")
    slices = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lengths) - 1, F.lit(0)), F.lit(n)), lambda at: F.slice(lengths, at + 1, n))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    totals = F.transform(slices, lambda s: F.aggregate(s, zero, lambda a, x: a + x))
    before = F.aggregate(totals, F.array(zero), grow)
    each = F.zip_with(slices, F.slice(before, 1, F.size(totals)), lambda s, b: F.slice(F.aggregate(s, F.array(b), grow), 1, F.size(s)))
    return F.flatten(each)


def format_chats(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    Input: ``conv_id, turn, role, text``; other columns are ignored. Turns are ordered by ``turn``
    (nulls first), equal numbers by role, then text; repeated rows are separate turns. A null role or text
    is the empty string. Rows with a null ``conv_id`` form one conversation with a null id. An
    empty table gives an empty result. ``loss_spans`` holds (start from 0, length) in code points.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    # A block begins where the role changes; it is a slice of the turns, so blocks cost their turns once.
    role = lambda i: F.get("turns", i)["role"]
    begins = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

    def block(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("begins", k + 1), F.size("turns"))
        return F.struct(role(at).alias("role"), F.transform(F.slice("turns", at + 1, end - at), lambda t: escape(t["text"])).alias("texts"))

    blocks = gathered.withColumn("begins", begins).select("conv_id", F.transform("begins", block).alias("blocks"))
    texts = blocks.select(
        "conv_id",
        "blocks",
        F.transform(
            "blocks",
            lambda b: F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END)),
        ).alias("parts"),
    )
    # Start of each block, then of each text in it, by running sums of lengths.
    starts = running(F.transform("parts", lambda p: F.char_length(p).cast("long")))

    def spans(b: Column, i: Column, at: Column) -> Column:
        first = F.get(at, i) + len(START) + F.char_length(escape_role(b["role"])) + 1
        steps = F.transform(b["texts"], lambda t: (F.char_length(t) + len(SEP)).cast("long"))
        at_each = F.arrays_zip(running(steps).alias("before"), b["texts"].alias("text"))
        found = F.transform(at_each, lambda z: F.struct((first + z["before"]).cast("long").alias("start"), F.char_length(z["text"]).cast("long").alias("length")))
        nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")
        return F.when(b["role"] == F.lit(trained_role), found).otherwise(nothing)

    return (
        texts.withColumn("starts", starts)
        .select(
            "conv_id",
            F.array_join("parts", "").alias("formatted"),
            F.flatten(F.transform("blocks", lambda b, i: spans(b, i, F.col("starts")))).alias("loss_spans"),
        )
    )


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back: ``conv_id, turns`` (array of role, text) and ``loss_texts`` under the mask."""
    blocks = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda b: b != F.lit(""))
    head = lambda b: F.substring_index(b, "\n", 1)
    body = lambda b: b.substr(F.char_length(head(b)) + 2, F.char_length(b))
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(body(b), r"<\|im_sep\|>", -1),
                lambda t: F.struct(
                    unescape_role(head(b).substr(F.lit(len(START) + 1), F.char_length(b))).alias("role"), unescape(t).alias("text")
                ),
            ),
        )
    )
    under = F.transform(
        "loss_spans", lambda s: unescape(F.col("formatted").substr((s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), under.alias("loss_texts"))


def chat_report(turns: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from the output."""
    # The formatted text is made once; without the cut the optimizer copies its expression into each use.
    out = parse_chats(format_chats(turns).repartition("conv_id"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
