"""Preference formatting in DataFrame operations only: a common prompt rendered once, and two masked completions.

Chosen and rejected conversations are rows, one per turn. The first turn at which they differ is a minimum over turns, so a
conversation of any length is never gathered in one place: :func:`format_preferences` has one row per rendered turn, with ``part``
prompt, chosen or rejected, and ``trained_from``, the character after the turn's header from which on an assistant's turn of a
completion is trained. :func:`paired` makes of these one row a pair, with the prompt once and two masked completions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, require

_LAST = (1 << 62) - 1


def _safe(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("|>"), F.lit("| >"))


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), _safe(role), F.lit("|>\n"))


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template. Marks of the template inside a text are broken by a space, so that a text can't end its turn."""
    return F.concat(header(role), _safe(text), F.lit("<|end|>\n"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """chosen, rejected (pair_col, turn, role, text) -> (pair_col, part, turn, role, rendered, trained, trained_from).

    The prompt is the longest run of turns, from the first, at which both sides have the same roles and texts; it is taken from
    the chosen side. Turns are told by their number: rows with the same number are compared together, whatever their order, and a
    number that one side lacks is a difference. A null turn comes last; null roles and texts are empty; rows without a pair are
    left out. Pairs that don't differ give a prompt alone; a side that is missing gives no completion. Repeated rows are repeated
    turns. Very long texts and conversations are no case apart. Empty tables give no rows. Extra columns are not read. The header and the
    prompt are never trained; a trained turn is from ``trained_from`` to its end, its end mark included.
    """
    for side in (chosen, rejected):
        require(side, pair_col, "turn", "role", "text")
    own = lambda df, part: df.where(F.col(pair_col).isNotNull()).select(F.col(pair_col), F.lit(part).alias("part"), F.coalesce(F.col("turn").cast("long"), F.lit(_LAST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = own(chosen, "chosen").unionByName(own(rejected, "rejected"))
    # One number for what a side says at a turn: equal for equal rows, and one shuffle of numbers rather than of texts.
    said = turns.select(pair_col, "turn", F.when(F.col("part") == "chosen", 1).otherwise(-1).alias("side"), F.xxhash64("role", "text").alias("h"), F.hash("text", "role").alias("g"))
    balance = said.groupBy(pair_col, "turn").agg(F.sum("side").alias("n"), F.sum((F.col("h") * F.col("side")).cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("long") * F.col("side")).alias("g"))
    differs = balance.where("n <> 0 or h <> 0 or g <> 0").groupBy(F.col(pair_col).alias("_pair")).agg(F.min("turn").alias("_from"))
    placed = turns.join(differs, turns[pair_col] == differs["_pair"], "left").withColumn("_common", F.col("_from").isNull() | (F.col("turn") < F.col("_from")))
    kept = placed.where(~(F.col("_common") & (F.col("part") == "rejected")))
    trained = ~F.col("_common") & (F.col("role") == "assistant")
    return kept.select(
        pair_col,
        F.when(F.col("_common"), "prompt").otherwise(F.col("part")).alias("part"),
        "turn",
        "role",
        rendered(F.col("role"), F.col("text")).alias("rendered"),
        trained.alias("trained"),
        F.when(trained, F.length(header(F.col("role")))).alias("trained_from"),
    )


def paired(turns: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """Rows of :func:`format_preferences` -> one row a pair: prompt, chosen, rejected, chosen_spans, rejected_spans.

    Texts are the turns' in order (of equal turns, by role and text). Spans are the trained (start, end) characters of a completion. A part without
    turns is empty. A pair's texts must fit one row; the rows of turns stand for longer ones. An empty table gives no rows.
    """
    entry = F.struct("part", "turn", "role", "rendered", "trained_from")
    out = turns.groupBy(pair_col).agg(F.array_sort(F.collect_list(entry)).alias("_turns"))
    of = lambda part: F.filter("_turns", lambda x: x["part"] == part)
    text = lambda part: F.array_join(F.transform(of(part), lambda x: x["rendered"]), "")
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        end = state["at"] + F.length(x["rendered"])
        span = F.array(F.struct((state["at"] + x["trained_from"]).alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["trained_from"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], span)).alias("spans"))

    spans = lambda part: F.aggregate(of(part), nothing, add)["spans"]
    return out.select(pair_col, *[text(p).alias(p) for p in ("prompt", "chosen", "rejected")], *[spans(p).alias(f"{p}_spans") for p in ("chosen", "rejected")])


def replies_against_partner(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chosen and a rejected side for each conversation with a reply (a turn of an assistant).

    Chosen is the conversation up to its last reply; rejected is the same with that reply replaced by the last reply of its
    partner, whose conv_id, a whole number, differs in the lowest bit; without a partner's reply, by an empty one. Without a reply of its
    own a conversation is its own prompt. Of several last replies the least text counts. Rows without conv_id are left out; a null turn
    is no last reply; a null role is no assistant's; a null text is empty. Repeated rows stay repeated. Empty tables give no rows; extra
    columns are not read. The last replies, a row for each conversation, are written once.
    """
    require(conversations, "conv_id", "turn", "role", "text")
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    said = turns.where("role = 'assistant' and turn is not null").groupBy("pair_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    replies = cut(said.groupBy("pair_id").agg(F.max("turn").alias("_last"), F.max_by("text", "turn").alias("_reply")).withColumnRenamed("pair_id", "_conv"), "replies")
    last = replies.select("_conv", "_last")
    marked = turns.join(last, turns["pair_id"] == last["_conv"], "left").drop("_conv")
    upto = marked.where("_last is null or turn <= _last")
    theirs = replies.select(F.col("_conv").bitwiseXOR(F.lit(1)).alias("_to"), "_reply")
    swapped = last.join(theirs, last["_conv"] == theirs["_to"], "left").select(F.col("_conv").alias("pair_id"), F.col("_last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("_reply", F.lit("")).alias("text"))
    before = marked.where("_last is null or turn < _last").select("pair_id", "turn", "role", "text")
    same_turn = marked.where("turn = _last and role <> 'assistant'").select("pair_id", "turn", "role", "text")
    return upto.select("pair_id", "turn", "role", "text"), before.unionByName(same_turn).unionByName(swapped)
