r"""Chat formatting by prefix-target expansion (DataFrame and SQL functions only).

Every assistant turn becomes an example of its own: all preceding turns are
its context and only that reply is trainable. Turns after the last assistant
turn form one more example with nothing trainable, so that the output holds
every turn. The text of an example is its turns in the template
``<turn:ROLE>TEXT</turn>`` and a line feed; the loss mask is a span of the
example (``loss_start``, from 0, and ``loss_chars``, code points).

Control strings consist of ``<`` and ``>``. In roles and texts these and the
escape character are written ``\l``, ``\g`` and ``\b``, so that an example
holds control strings only where the template put them, and reading it back
(``read_turns``, ``unescape``) returns every text unchanged.

Scale: one shuffle by conversation. An example holds its conversation's whole
prefix by definition, so the rows of one conversation meet in one row.

Defined results: null text and null role count as empty; rows without conv_id
are one conversation; turns go by turn number, nulls first, ties by role, then
text; repeated rows are turns of their own; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN, END = "<turn:", "</turn>\n"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def format_examples(turns: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_chars): one row
    for each assistant turn, and one for an unanswered tail (loss_chars 0)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    shown = F.concat(F.lit(OPEN), escape(role), F.lit(">"), escape(text), F.lit(END))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        shown.alias("shown"), F.length(escape(text)).alias("chars")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    n = F.size("ts")
    # places (from 1) of assistant turns, and the end if it is not one of them
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("ts", i - 1)["role"] == "assistant") | (i == n))
    exploded = convs.select("conv_id", "ts", F.posexplode(ends).alias("example", "at"))
    reply = F.get("ts", F.col("at") - 1)
    formatted = F.array_join(F.transform(F.slice("ts", F.lit(1), F.col("at")), lambda t: t["shown"]), "")
    trained = reply["role"] == "assistant"
    return (exploded.select("conv_id", F.col("example").cast("long").alias("example"),
                            F.col("at").cast("long").alias("n_turns"), formatted.alias("formatted"),
                            F.when(trained, reply["chars"]).otherwise(0).cast("long").alias("loss_chars"))
            .withColumn("loss_start", F.length("formatted") - len(END) - F.col("loss_chars")))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of an example's text."""
    parts = F.filter(F.split(formatted, END, -1), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), ">", 1)).alias("role"),
        unescape(F.substring_index(p, ">", -1)).alias("text")))


def masked_text(row_formatted: str = "formatted") -> Column:
    """The unescaped text under an example's loss mask."""
    return unescape(F.substr(F.col(row_formatted), (F.col("loss_start") + 1).cast("int"),
                             F.col("loss_chars").cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """One row per conversation, computed from the examples' texts and masks."""
    parsed = examples.select(
        "conv_id", "example", F.length("formatted").cast("long").alias("chars"), masked_text().alias("loss"),
        F.when(F.col("example") == F.max("example").over(_by_conv()), read_turns(F.col("formatted"))).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = parsed.select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"),
                        F.when(F.col("turns").isNotNull(), F.sha2(whole, 256)).alias("sha"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return (per.groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"),
                                       loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
            .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                    F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))


def _by_conv():
    from pyspark.sql import Window
    return Window.partitionBy("conv_id")


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
o AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
        length(role) + length(text) + 15
        + length(regexp_replace(role || text, '[^<>\\]', '', 'g')) AS shown
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY place) AS chars FROM o)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) FILTER (role = 'assistant' OR place = n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
