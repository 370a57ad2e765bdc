"""Preference formatting of conversations, with DataFrame functions only.

Of a chosen and a rejected conversation the longest common prefix of turns is rendered once, as the prompt. The
rest of either is its completion, with the spans of characters that a loss may count: the assistant's texts and
their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turns): one row a conversation, its turns as array<struct<role, text>> in order of turn, then role, then text.

    Repeated turns all stay, one after another. Rows with null key are one conversation, under a null key.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), F.col(role), F.col(text))))
    return turns.groupBy(key).agg(F.transform(ordered, lambda x: F.struct(x[role].alias("role"), x[text].alias("text"))).alias("turns"))


def _plain(c: Column) -> Column:
    """Marks within a text are broken up, so that no text can forge a turn; null is empty."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), _plain(t["role"]), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(_plain(t["text"]), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns at the start of two arrays have equal role and text; null equals null."""
    same = F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _running(sizes: Column) -> Column:
    """The sums of the first 1, 2, ... elements, by adding the array to itself moved by 1, 2, 4, ...: n log n steps."""
    shifts = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(sizes) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    moved = lambda run, by: F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), by), run), F.lit(1), F.size(run))
    return F.aggregate(shifts, sizes, lambda run, by: F.zip_with(run, moved(run, by), lambda x, y: x + y))


def trained_spans(turns: Column) -> Column:
    """array<struct<start, end>>: character spans of the rendered turns that belong to the assistant's bodies."""
    body = lambda t: F.length(_body(t)).cast("long")
    ends = _running(F.transform(turns, lambda t: F.length(_head(t)) + body(t)))
    trained = F.zip_with(turns, ends, lambda t, end: F.when(t["role"] == TRAINED, F.struct((end - body(t)).alias("start"), end.alias("end"))))
    return F.filter(trained, lambda s: s.isNotNull())


def format_preferences(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected", into: str = "preference") -> DataFrame:
    """pairs with one more column `into`: struct<n_prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans>.

    chosen and rejected are array<struct<role, text>>; a null array is an empty one. If one conversation is a
    prefix of the other, its completion is empty; so are both if they are equal. Null roles and texts render as
    empty and equal each other. Repeated rows get equal results; an empty table stays empty; a column named
    `into` is replaced, others stay.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    a, b = F.coalesce(F.col(chosen), empty), F.coalesce(F.col(rejected), empty)
    # each step is a projection of its own, so that no array is built twice
    cut = pairs.withColumns({"__a": a, "__b": b}).withColumn("__n", common_prefix(F.col("__a"), F.col("__b")))
    rest = lambda c: F.slice(F.col(c), F.col("__n") + 1, F.greatest(F.lit(0), F.size(c) - F.col("__n")))
    cut = cut.withColumns({"__p": F.slice("__a", F.lit(1), F.col("__n")), "__ra": rest("__a"), "__rb": rest("__b")})
    formed = F.struct(
        F.col("__n").alias("n_prompt_turns"),
        render(F.col("__p")).alias("prompt"),
        render(F.col("__ra")).alias("chosen"),
        render(F.col("__rb")).alias("rejected"),
        trained_spans(F.col("__ra")).alias("chosen_spans"),
        trained_spans(F.col("__rb")).alias("rejected_spans"),
    )
    return cut.select(*[F.col(c) for c in pairs.columns if c != into], formed.alias(into))


def last_reply_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with its last assistant turn, and what follows,
    replaced by the last assistant turn of the conversation whose id differs in the lowest bit.

    Without an assistant turn, rejected is the conversation itself; without such a rival, it ends before the
    last assistant turn.
    """
    whole = conversations(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)))
    whole = whole.select("conv_id", "turns", last.alias("last"))
    rival = whole.where("last is not null").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("__of"), F.get("turns", F.col("last")).alias("reply"))
    joined = whole.join(rival, F.col("conv_id") == F.col("__of"), "left")
    before = F.slice("turns", F.lit(1), F.coalesce("last", F.lit(0)))
    reply = F.when(F.col("reply").isNull(), F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array("reply"))
    rejected = F.when(F.col("last").isNull(), F.col("turns")).otherwise(F.concat(before, reply))
    return joined.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))


LAST_REPLY_SQL = """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM conversations
), ids AS (SELECT DISTINCT conv_id FROM t),
last AS (SELECT conv_id, max(pos) AS pos, max_by(text, pos) AS text FROM t WHERE role = 'assistant' GROUP BY conv_id),
sides AS (
  SELECT conv_id, 'a' AS side, pos, role, text FROM t
  UNION ALL SELECT t.conv_id, 'b', t.pos, t.role, t.text FROM t LEFT JOIN last USING (conv_id) WHERE last.pos IS NULL OR t.pos < last.pos
  UNION ALL SELECT own.conv_id, 'b', own.pos, 'assistant', rival.text FROM last own JOIN last rival ON rival.conv_id = xor(own.conv_id, 1)
), pairs AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.pos, b.pos) AS pos,
    a.pos IS NOT NULL AND b.pos IS NOT NULL AND a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS same
  FROM (SELECT * FROM sides WHERE side = 'a') a FULL JOIN (SELECT * FROM sides WHERE side = 'b') b ON a.conv_id = b.conv_id AND a.pos = b.pos
), cut AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE NOT same) - 1, max(pos)) AS n FROM pairs GROUP BY conv_id),
parts AS (
  SELECT conv_id, side, pos, n, role, '<|' || replace(coalesce(role, ''), '<|', '< |') || '|>' || chr(10) AS head,
    replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM sides JOIN cut USING (conv_id)
), placed AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, side, pos > n ORDER BY pos) AS upto FROM parts
)
SELECT ids.conv_id, CAST(any_value(cut.n) AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos <= p.n), '') AS prompt,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > p.n), '') AS chosen,
  coalesce(string_agg(head || body, '' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > p.n), '') AS rejected,
  coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 'a' AND pos > p.n AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((upto - length(body))::BIGINT || '-' || upto::BIGINT, ',' ORDER BY pos) FILTER (WHERE side = 'b' AND pos > p.n AND role = 'assistant'), '') AS rejected_spans
FROM ids JOIN cut USING (conv_id) JOIN placed p USING (conv_id) GROUP BY ids.conv_id
"""
