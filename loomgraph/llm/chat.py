"""Preference formatting of conversations (DataFrame functions only).

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt; what is left
of each is its completion, whose assistant turns carry loss 1 and all other turns loss 0.

A conversation, its prompt and its completions are one row each, as their output is one text. A ``<|`` inside a role or
text is written ``<\\|``, so no text can open or end a turn.

Defined cases: a null role renders as an empty role and a null text as an empty text; two nulls are equal; equal
conversations share every turn and have empty completions; a missing conversation is an empty one; rows without a
conversation id take no part; repeated turns are all kept, in the order of turn, role, text; input columns beyond
conv_id, turn, role, text are ignored; an empty table gives an empty result; texts are rendered whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.columns import quoted, unused

TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    return (
        turns.where(F.col("conv_id").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def escaped(text: Column) -> Column:
    """The text, empty for null, without turn markers."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def render(turn: Column) -> Column:
    """One turn in chat markup."""
    return F.concat(F.lit("<|"), escaped(turn["role"]), F.lit("|>\n"), escaped(turn["text"]), F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, render), "")


def loss_mask(turns: Column) -> Column:
    """A digit for each turn: 1 where the loss counts."""
    return F.array_join(F.transform(turns, lambda x: F.when(x["role"] == "assistant", "1").otherwise("0")), "")


def spans(turns: Column) -> Column:
    """(start, end) of each assistant text in the rendered completion, in characters."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    first = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(state, turn):  # one pass: the offset so far travels with the spans
        end = state["at"] + F.length(render(turn))
        own = F.struct((state["at"] + F.length(escaped(turn["role"])) + 5).alias("start"), (end - 8).alias("end"))
        found = F.when(turn["role"] == "assistant", F.concat(state["found"], F.array(own))).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    return F.aggregate(turns, first, step, lambda state: state["found"])


def preference(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with arrays of turns -> other columns, n_shared, prompt, and for both sides the completion, its loss
    mask by turn and the character spans of its assistant texts."""
    none = F.array().cast(f"array<{TURN}>")
    a, b = F.coalesce(F.col(chosen), none), F.coalesce(F.col(rejected), none)
    same = F.zip_with(a, b, lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    n = F.when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")
    made = (chosen, rejected, "n_shared", "prompt", "chosen_text", "rejected_text", "chosen_mask", "rejected_mask",
            "chosen_spans", "rejected_spans")
    kept = [c for c in pairs.columns if c.lower() not in made]
    left, right = unused([*pairs.columns, *made], "left", "right")
    cut = pairs.select(*quoted(kept), a.alias(left), b.alias(right), least_two(n, a, b).alias("n_shared"))
    rest = quoted(kept)
    tail = lambda c: F.slice(c, F.col("n_shared") + 1, F.greatest(F.size(c), F.lit(1)))
    return cut.select(
        *rest,
        "n_shared",
        rendered(F.slice(left, F.lit(1), F.col("n_shared"))).alias("prompt"),
        rendered(tail(F.col(left))).alias("chosen_text"),
        rendered(tail(F.col(right))).alias("rejected_text"),
        loss_mask(tail(F.col(left))).alias("chosen_mask"),
        loss_mask(tail(F.col(right))).alias("rejected_mask"),
        spans(tail(F.col(left))).alias("chosen_spans"),
        spans(tail(F.col(right))).alias("rejected_spans"),
    )


def least_two(n: Column, a: Column, b: Column) -> Column:
    """``n`` bounded by both lengths: a turn that only one side has is no common turn."""
    return F.least(n, F.size(a), F.size(b))


def swapped_replies(convs: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with its last assistant text exchanged for that
    of its neighbour (ids 2k and 2k+1). The table has no preference labels; a foreign reply is the worse one. Without
    a neighbour's reply the rejected side ends before the last assistant turn; without an assistant turn both sides
    are equal. One equi-join on the id, one row for each conversation.
    """
    last = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda x: F.coalesce(x["role"], F.lit("")))), "assistant") + 1
    found = F.array_contains(F.transform("turns", lambda x: F.coalesce(x["role"], F.lit(""))), "assistant")
    at = convs.select("conv_id", "turns", F.when(found, last).cast("int").alias("at"))
    other = at.where("at is not null").select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("turns", F.col("at"))["text"].alias("reply"), F.lit(True).alias("has")
    )
    role = F.lit("assistant").alias("role")
    head = F.slice("turns", F.lit(1), F.col("at") - 1)
    return at.join(other, "conv_id", "left").select(
        "conv_id",
        F.col("turns").alias("chosen"),
        F.when(F.col("at").isNull(), F.col("turns"))
        .when(F.col("has"), F.concat(head, F.array(F.struct(role, F.col("reply").alias("text")))))
        .otherwise(head)
        .alias("rejected"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Preference rows of every conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = preference(swapped_replies(conversations(turns)))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumns({c: told(c) for c in ("chosen_spans", "rejected_spans")})


_RENDER = r"""'<|' || replace(coalesce(x.role, ''), '<|', '<\|') || '|>' || chr(10) || replace(coalesce(x.text, ''), '<|', '<\|') || '<|end|>' || chr(10)"""
_TEXT = "coalesce(array_to_string(list_transform({turns}, lambda x: " + _RENDER + "), ''), '')"
_MASK = "coalesce(array_to_string(list_transform({turns}, lambda x: CASE WHEN x.role = 'assistant' THEN '1' ELSE '0' END), ''), '')"
# where each turn of the completion ends: the lengths before it, summed
_SPANS = """(SELECT coalesce(string_agg((upto - size + 14) || '-' || (upto - 8), ',' ORDER BY i), '') FROM (SELECT i, role, size,
    sum(size) OVER (ORDER BY i) AS upto FROM (SELECT unnest(range(1, len({turns}) + 1)) AS i, unnest(list_transform({turns}, lambda x: x.role)) AS role,
    unnest(list_transform({turns}, lambda x: length(""" + _RENDER + """))) AS size)) WHERE role = 'assistant')"""
OP3_SQL = r"""
WITH c AS (SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role, text) AS t
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
l AS (SELECT conv_id, t, list_max(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN t[i].role = 'assistant' THEN i END)) AS pos
    FROM c),
o AS (SELECT xor(conv_id, 1) AS conv_id, t[pos].text AS reply FROM l WHERE pos IS NOT NULL),
p AS (SELECT l.conv_id, list_transform(t, lambda x: {'role': x.role, 'text': x.text}) AS a, CASE WHEN pos IS NULL
    THEN list_transform(t, lambda x: {'role': x.role, 'text': x.text})
    WHEN o.conv_id IS NOT NULL THEN list_append(list_transform(t[1:pos - 1], lambda x: {'role': x.role, 'text': x.text}),
        {'role': 'assistant', 'text': reply})
    ELSE list_transform(t[1:pos - 1], lambda x: {'role': x.role, 'text': x.text}) END AS b
    FROM l LEFT JOIN o ON l.conv_id = o.conv_id),
n AS (SELECT *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1),
    lambda i: a[i] IS DISTINCT FROM b[i])) - 1, least(len(a), len(b))) AS k FROM p),
d AS (SELECT conv_id, k, a[1:k] AS head, a[k + 1:] AS ta, b[k + 1:] AS tb FROM n)
SELECT conv_id, k::INT AS n_shared,
    """ + ",\n    ".join(
    [_TEXT.format(turns="head") + " AS prompt"]
    + [f"{how.format(turns=t)} AS {side}_{name}" for how, name in ((_TEXT, "text"), (_MASK, "mask"), (_SPANS, "spans")) for t, side in (("ta", "chosen"), ("tb", "rejected"))]
) + "\nFROM d\n"
