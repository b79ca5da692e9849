"""Chat formatting: every assistant turn becomes an example of its own, trained on alone, with all earlier turns as context.

A conversation is stored as segments `<|turn:ROLE|>TEXT<|end|>`; an example is its context, all segments before the assistant's text, that
text as its target, and the span of its loss mask. A conversation of n assistant turns gives n contexts, so its examples take space with the
square of its turns, which is what the method asks for; no task holds more than one context and the turns of one conversation at once.

Control strings in a text can't be taken for marks: `&`, `<`, `[` and `|` are escaped, and unescape() gives the text back.

Defined cases: null texts and roles are empty; turns go by turn, then role, then text, so ties and repeated rows have one
order; a null conv_id is a conversation like any other; conversations without an assistant turn give no example; extra
columns are left out. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skerry.session import table

TURN, CLOSE, END = "<|turn:", "|>", "<|end|>"
HEAD = f"assistant{CLOSE}"  # of an assistant turn, after TURN
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"), ("|", "&vert;"))  # the first one is undone last


def escape(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def format_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, segment, start, body_start, body_end, trainable): turns in order with their places in the
    conversation's formatted text. Running sums give the places; no conversation is gathered for it."""
    turns = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(CLOSE))
    turns = turns.select("conv_id", "role", F.row_number().over(order).alias("place"), head.alias("head"), escape(F.col("text")).alias("body"), F.sum(F.char_length(head) + F.char_length(escape(F.col("text"))) + len(END)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    body_end = F.col("until") - len(END)
    return turns.select(
        "conv_id",
        "place",
        F.concat("head", "body", F.lit(END)).alias("segment"),
        (body_end - F.char_length("body") - F.char_length("head")).alias("start"),
        (body_end - F.char_length("body")).alias("body_start"),
        body_end.alias("body_end"),
        (F.col("role") == "assistant").alias("trainable"),
    )


def expand(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: its context is all of the formatted conversation before its text, [0, target_start), and its loss mask covers
    [target_start, target_end) and nothing else. Contexts are repeated by nature; a conversation's rows are made one after the other."""
    before = F.collect_list("segment").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    rows = turns.withColumn("_before", before).where("trainable")
    head, target = F.expr("substring(segment, 1, int(body_start - start))"), F.expr("substring(segment, int(body_start - start) + 1, int(body_end - body_start))")
    return rows.select("conv_id", F.col("place").alias("example"), F.concat(F.array_join("_before", ""), head).alias("context"), F.col("body_start").alias("target_start"), F.col("body_end").alias("target_end"), target.alias("target"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, example, context, target): examples as a trainer reads them."""
    return expand(turns).select("conv_id", "example", "context", "target")


def checked(examples: DataFrame) -> DataFrame:
    """(conv_id, place, target, whole): whole is an assistant turn's context and text, of a conversation's last example. Stops if a context doesn't
    end with the head of the assistant turn at its place where its span says, or doesn't go on from the example before it."""
    order = Window.partitionBy("conv_id").orderBy("example")
    text = F.concat("context", "target", F.lit(END))
    rows = examples.withColumns({"_text": text, "_earlier": F.lag(text).over(order), "_last": F.lead("example").over(order).isNull()})
    turns = (F.char_length("context") - F.char_length(F.replace("context", F.lit(TURN), F.lit("")))) / len(TURN)
    good = F.endswith("context", F.lit(TURN + HEAD)) & (turns == F.col("example")) & F.startswith("context", F.coalesce("_earlier", F.lit("")))
    good = good & (F.char_length("context") == F.col("target_start")) & (F.char_length("target") == F.col("target_end") - F.col("target_start"))
    stop = F.raise_error(F.lit("an example's context isn't a prefix of its conversation up to its target")).cast("string")
    return rows.select("conv_id", F.col("example").alias("place"), F.when(good, F.col("target")).otherwise(stop).alias("target"), F.when(F.col("_last"), F.col("_text")).alias("whole"))


def op5_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted and expanded, then read back from the examples: a conversation from its last example and the turns after it, the
    text under the loss mask from every example's target."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = format_turns(rows.unionByName(extra))
    examples = checked(expand(turns)).withColumn("tail", F.lit(None).cast("string"))
    last = F.max(F.when(F.col("trainable"), F.col("body_end"))).over(Window.partitionBy("conv_id"))
    # turns that no example holds; found by their spans, they need what expand() needs, so one shuffle of the turns serves both
    tails = turns.withColumn("_last", last).where("_last IS NULL OR start > _last")
    nothing = F.lit(None).cast("string")
    items = examples.unionByName(tails.select("conv_id", "place", nothing.alias("target"), nothing.alias("whole"), F.col("segment").alias("tail")))
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("place", c)))), lambda x: x[c]), "")
    whole = items.groupBy("conv_id").agg(F.concat(joined("whole"), joined("tail")).alias("formatted"), unescape(joined("target")).alias("loss"))
    whole = whole.withColumn("parts", F.expr("filter(split(formatted, '<[|]turn:'), (x, i) -> i > 0)"))
    read = F.expr(f"transform(parts, x -> concat(substring_index(x, '{CLOSE}', 1), '\\n', substring(x, instr(x, '{CLOSE}') + 2, length(x) - instr(x, '{CLOSE}') - 1 - {len(END)}), '\\n'))")
    whole = whole.withColumn("turns", read)
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(unescape(F.array_join("turns", "")), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
