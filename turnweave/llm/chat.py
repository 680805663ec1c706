"""Chat formatting with Spark expressions only.

A conversation becomes ``<|im_start|>role\\n text <|im_end|>\\n`` per run of adjacent turns of one role; the texts of a
run are joined by ``<|im_sep|>``, so that single turns can be read back. Inside texts a backslash is written ``\\\\`` and
``<|`` is written ``<\\|``: no control string can stand there, and each backslash pair undoes itself. Roles are
URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant"
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``: where the texts of ``loss_role`` stand in ``formatted``, as
    half-open ranges of code points (``start, end``) and of UTF-8 bytes (``first_byte, end_byte``).

    Turns go by number, nulls first, then role and text; repeated rows stay. Null text or role: empty. Null ids form one
    conversation. Empty table: no rows. A conversation is one row, so its turns meet in one task; sums of lengths are
    window sums in the partitioning that the collection uses, one shuffle for all.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.url_encode(F.coalesce(F.col(f"`{role}`"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    before = F.lag("role").over(order)
    rows = rows.select("*", F.row_number().over(order).alias("no"), before.alias("before")).withColumn("opens", F.col("before").isNull() | (F.col("before") != F.col("role")))
    # an opening turn closes the run before it and writes its own head; any other turn writes a separator
    lead = F.when(F.col("opens"), F.length("role") + F.lit(len(START) + 1) + F.when(F.col("no") > 1, len(END)).otherwise(0)).otherwise(len(SEP)).cast("long")
    # what a turn leads with is ASCII: as many bytes as code points
    upto = lambda size: F.sum(lead + size("text")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select("conv_id", "no", "role", "text", "opens", upto(F.length).alias("to"), upto(F.octet_length).alias("to_byte"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("no", "role", "text", "opens", "to", "to_byte"))).alias("turns"))
    opens = F.transform(F.filter("turns", lambda t: t["opens"]), lambda t: t["no"])
    runs = F.transform(
        "opens",
        lambda no, i: F.struct(
            F.element_at("turns", no)["role"].alias("role"),
            F.slice("turns", no, F.coalesce(F.get("opens", i + 1), F.size("turns") + 1) - no)["text"].alias("texts"),
        ),
    )
    merged = F.transform("runs", lambda r: F.concat(F.lit(START), r["role"], F.lit("\n"), F.array_join(r["texts"], SEP), F.lit(END)))
    lost = F.filter("turns", lambda t: t["role"] == F.url_encode(F.lit(loss_role)))
    spans = F.transform(lost, lambda t: F.struct((t["to"] - F.length(t["text"])).alias("start"), t["to"].alias("end"), (t["to_byte"] - F.octet_length(t["text"])).alias("first_byte"), t["to_byte"].alias("end_byte")))
    return grouped.withColumn("opens", opens).withColumn("runs", runs).select("conv_id", F.array_join(merged, "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: str = "formatted") -> Column:
    """The turns (array of role, text), parsed from the formatted string alone."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.greatest(F.lit(0), F.size(F.split(formatted, r"<\|im_start\|>")) - 1))

    def turns(block: Column) -> Column:
        head = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.length(head) + 2, F.length(block) - F.length(head) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(F.url_decode(head).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """Read-back digests of ``format_conversations``. Spans are cut by bytes: code points would be counted from the string's start
    for each."""
    raw = F.col("formatted").cast("binary")
    cut = lambda s: F.substr(raw, (s["first_byte"] + 1).cast("int"), (s["end_byte"] - s["first_byte"]).cast("int")).cast("string")
    lost = unescape(F.array_join(F.transform("loss_spans", cut), ""))
    parsed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return formatted.withColumn("turns", read_back()).withColumn("loss", lost).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(parsed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
