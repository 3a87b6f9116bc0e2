"""Operators over message turns: (conversation, turn, role, text) rows or message arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_messages(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation with its messages in turn order."""
    message = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(message)).alias("messages"))


def turns_of(messages: Column, role: str) -> Column:
    """Texts of a role's messages that aren't blank, in order."""
    return F.transform(F.filter(messages, lambda m: (m["role"] == role) & (F.trim(m["text"]) != "")), lambda m: m["text"])


def public_dialogue(messages: Column, roles: Sequence[str] = ("user", "assistant"), separator: str = "\n") -> Column:
    """The visible messages as ``role: text`` lines."""
    shown = F.filter(messages, lambda m: m["role"].isin(*roles))
    return F.array_join(F.transform(shown, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))), separator)


def previous_user(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Assistant turns with the last user text before them."""
    before = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(before)
    return turns.withColumn("user_text", last).where(F.col(role) == "assistant")


def last_attempt(turns: DataFrame, *, key: Sequence[str], attempt: str, values: Sequence[str]) -> DataFrame:
    """The values of the last attempt of each turn."""
    return turns.groupBy(*key).agg(*[F.max_by(v, attempt).alias(v) for v in values])


def first_flagged(turns: DataFrame, flag: Column, *, key: str, turn: str) -> DataFrame:
    """The first flagged turn of each conversation; null where there is none."""
    return turns.groupBy(key).agg(F.min(F.when(flag, F.col(turn))).alias("first_turn"))


def is_subsequence(wanted: Column, found: Column) -> Column:
    """Whether the wanted items occur in that order among the found ones."""
    step = lambda at, x: F.when((at < F.size(wanted)) & x.eqNullSafe(F.get(wanted, at)), at + 1).otherwise(at)
    return F.aggregate(found, F.lit(0), step) == F.size(wanted)


def seen_so_far(turns: DataFrame, value: Column, *, key: str, turn: str) -> DataFrame:
    """Each turn with the distinct values up to it."""
    upto = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.withColumn("seen", F.array_sort(F.collect_set(value).over(upto)))


def exchanges(turns: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Assistant replies numbered from 1, with the user text they answer."""
    rows = previous_user(turns, key=key, turn=turn, role=role, text=text)
    return rows.withColumn("exchange", F.row_number().over(Window.partitionBy(key).orderBy(turn)))


def contradictions(turns: DataFrame, flagged: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """The exchanges that ``flagged`` (key, exchange) names."""
    return exchanges(turns, key=key).join(flagged.select(key, "exchange").distinct(), [key, "exchange"]).select(key, "exchange", "user_text", F.col("text").alias("reply"))


def pair_turns(left: DataFrame, right: DataFrame, *, key: str, turn: str) -> DataFrame:
    """The n-th left row of a conversation with its n-th right row."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(turn))
    return left.withColumn("_n", number).join(right.withColumn("_n", number).withColumnRenamed(turn, f"right_{turn}"), [key, "_n"]).drop("_n")


def merge_passages(spans: DataFrame, *, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching spans of a key as one; a span without a start comes last and adds to the passage before it.

    Both windows have one order, so one sort serves both and spans that tie can't change places between them.
    """
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_reach", reach).withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0))
    grouped = marked.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return grouped.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")


def working_set(retrieved: DataFrame, *, key: str, turn: str, doc: str, turns_back: int) -> DataFrame:
    """Each turn's documents of the last turns, once each, with the latest turn they came in."""
    now = retrieved.select(key, F.col(turn).alias("at")).distinct()
    joined = now.join(retrieved, key).where((F.col(turn) <= F.col("at")) & (F.col(turn) > F.col("at") - turns_back))
    return joined.groupBy(key, "at", doc).agg(F.max(turn).alias("latest"))
