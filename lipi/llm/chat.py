"""Chat formatting with Spark expressions only.

Turns are collected per conversation as structs, sorted, cut into runs of one
role by array functions, and concatenated:

    <|im_start|>ROLE\\nTEXT<|im_turn|>TEXT<|im_end|>\\n

Adjacent turns of one role share a header; ``<|im_turn|>`` stands between
their texts, so the merge can be undone. Control strings inside a text are
escaped reversibly: a backslash is doubled, then every ``<|`` becomes
``<\\|``; after that no text can hold a marker. A line feed in a role name
becomes ``<|nl|>``.

``segments`` holds the same output cut at the loss mask: its texts joined are
``formatted``, and ``loss`` marks the assistant texts (not the markers).

Defined results: null text or role counts as empty; a null turn sorts first;
ties in turn are ordered by role, then text; repeated rows stay (each is a
turn); a null conv_id is a conversation of its own; an empty table gives no
rows. Columns other than conv_id, turn, role, text are not read. One
conversation is one output row, so its text is bounded by the row size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, TURN, NL = "<|im_start|>", "<|im_end|>", "<|im_turn|>", "<|nl|>"
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _role_out(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit(NL))


def _role_in(c: Column) -> Column:
    return unescape(F.replace(c, F.lit(NL), F.lit("\n")))


def format_chats(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted string, segments array<struct<text, loss>>."""
    turn = F.struct(F.col("turn").alias("turn"),
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    turns = (df.groupBy("conv_id").agg(F.collect_list(turn).alias("t"))
             .select("conv_id", F.array_sort("t").alias("t")))
    # runs: positions where the role changes, then a slice of turns each
    starts = F.filter(F.sequence(F.lit(1), F.size("t")),
                      lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    cut = turns.withColumn("s", starts)
    run = F.transform(F.col("s"), lambda s, k: F.struct(
        F.element_at("t", s)["role"].alias("role"),
        F.transform(F.slice("t", s, F.coalesce(F.get("s", k + 1), F.size("t") + 1) - s),
                    lambda x: escape(x["text"])).alias("texts")))
    runs = cut.select("conv_id", run.alias("r"))

    def pieces(r):
        body = F.flatten(F.transform(r["texts"], lambda x, i: F.when(
            i == 0, F.array(F.struct(x.alias("text"), (r["role"] == loss_role).alias("loss")))).otherwise(
            F.array(F.struct(F.lit(TURN).alias("text"), F.lit(False).alias("loss")),
                    F.struct(x.alias("text"), (r["role"] == loss_role).alias("loss"))))))
        head = F.array(F.struct(F.concat(F.lit(START), _role_out(r["role"]), F.lit("\n")).alias("text"),
                                F.lit(False).alias("loss")))
        tail = F.array(F.struct(F.lit(END + "\n").alias("text"), F.lit(False).alias("loss")))
        return F.concat(head, body, tail)

    return (runs.select("conv_id", F.flatten(F.transform("r", pieces)).alias("segments"))
            .select("conv_id", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"),
                    "segments"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b):
        head = F.substring_index(b, "\n", 1)
        body = F.substr(b, F.length(head) + 2, F.greatest(F.length(b), F.lit(1)))
        role = _role_in(F.replace(head, F.lit(START), F.lit("")))
        return F.transform(F.split(body, r"<\|im_turn\|>", -1),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))
    return F.flatten(F.transform(blocks, turns))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the output of ``format_chats``."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    d = formatted.select("conv_id", read_back(F.col("formatted")).alias("t"), loss.alias("l"),
                         F.length("formatted").cast("long").alias("formatted_chars"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return d.select("conv_id", F.size("t").cast("long").alias("n_turns"),
                    F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
                    F.length("l").cast("long").alias("loss_chars"),
                    F.sha2(F.col("l").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
