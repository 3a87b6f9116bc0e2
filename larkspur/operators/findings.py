"""Evidence behind capability cells: findings by axis, judges' ratings by turn, transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import MESSAGES_SCHEMA, axis_score, normalized, number_in, parse_cell, scorer_state
from .reporting import CAPABILITIES, Capability, first_rows

FINDING = "array<struct<axis:string,source:string,judge:string,score:double,threshold:double,failed:boolean,is_critical:boolean,reasoning:string>>"


def _judge_finding(c: Column, axis: str) -> tuple[Column, Column, Column]:
    """(score, judge, reasoning): the judges' mean, and the first judge by name that gave a reason."""
    by = F.array_sort(F.map_entries(F.element_at(c["axes"], axis)))
    reasons = F.filter(by, lambda e: F.coalesce(e["value"]["reasoning"], F.lit("")) != "")
    scores = F.filter(F.transform(by, lambda e: F.nanvl(e["value"]["score"], F.lit(None).cast("double"))), lambda s: s.isNotNull())
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    return mean, F.get(reasons, 0)["key"], F.get(reasons, 0)["value"]["reasoning"]


def findings(cell: Column, capability: Capability) -> Column:
    """The findings of one evaluation cell for a capability, axis by axis in its order.

    Each axis that has a score or a reason gives one: failed says that the score is under the axis' threshold, both on one
    scale. A scorer that broke gives one first, failed and without a score; a scorer that named the turn at which the
    assistant gave in gives one that never fails (axis ``turn_of_flip``). An unreadable cell has none.
    """
    c = parse_cell(cell)
    none = F.expr("array()").cast(FINDING)
    parts = []
    owners = dict.fromkeys([*([capability.scorer] if capability.scorer else []), *capability.owners.values()])
    for owner in owners:
        block = F.element_at(c["scorers"], owner)
        made = F.struct(
            F.lit(f"{owner} (scorer error)").alias("axis"), F.lit(f"scorer:{owner}").alias("source"), F.lit(None).cast("string").alias("judge"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("failed"), F.lit(False).alias("is_critical"), F.coalesce(block["error"], F.lit("")).alias("reasoning"),
        )
        parts.append(F.when(scorer_state(block) == "error", F.array(made)).otherwise(none))
    for axis in capability.axes:
        owner = capability.owners.get(axis, capability.scorer)
        if owner is None:
            score, judge, reason = _judge_finding(c, axis)
        else:
            value = F.element_at(F.element_at(c["scorers"], owner)["scores"], axis)
            score, judge, reason = number_in(value), F.lit(None).cast("string"), F.get_json_object(value, "$.reasoning")
            # an owner that lacks the axis leaves it to whoever has it
            score = F.coalesce(score, axis_score(c, F.lit(axis))) if capability.scorer is None else score
        limit = float(capability.axis_thresholds.get(axis, capability.threshold))
        reason = F.coalesce(reason, F.lit(""))
        made = F.struct(
            F.lit(axis).alias("axis"), F.lit(f"scorer:{owner}" if owner else "judge").alias("source"), judge.alias("judge"), score.alias("score"), F.lit(limit).alias("threshold"),
            F.coalesce(normalized(F.lit(axis), score) < normalized(F.lit(axis), F.lit(limit)), F.lit(False)).alias("failed"), F.lit(axis in capability.critical).alias("is_critical"), reason.alias("reasoning"),
        )
        parts.append(F.when(score.isNotNull() | (reason != ""), F.array(made)).otherwise(none))
    if capability.scorer == "safety_chat_pressure":
        turn = F.get_json_object(cell, "$.scorers.safety_chat_pressure.turn_of_flip")
        made = F.struct(
            F.lit("turn_of_flip").alias("axis"), F.lit("scorer:safety_chat_pressure").alias("source"), F.lit(None).cast("string").alias("judge"), F.lit(None).cast("double").alias("score"),
            F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("failed"), F.lit(False).alias("is_critical"), F.concat(F.lit("The assistant first gave in at user turn "), turn, F.lit(".")).alias("reasoning"),
        )
        parts.append(F.when(turn.isNotNull(), F.array(made)).otherwise(none))
    return F.when(c.isNull(), none).otherwise(F.concat(none, *parts))


def turn_ratings(metadata: Column) -> Column:
    """The final attempt's rating of each turn, by turn, from a conversation's metadata (JSON); turns without a number come last.

    Of attempts with one number the later in the list counts. Anything unreadable is an empty list.
    """
    kind = "array<struct<turn_idx:int,attempt:int,rating:string,explanation:string,success:boolean>>"
    raw = F.coalesce(F.from_json(F.get_json_object(metadata, "$.assistant_judge_ratings"), kind), F.expr("array()").cast(kind))
    placed = F.transform(F.filter(raw, lambda e: e.isNotNull()), lambda e, i: F.struct(F.coalesce(e["turn_idx"], F.lit(2**31 - 1)).alias("t"), F.coalesce(e["attempt"], F.lit(0)).alias("a"), i.alias("i"), e.alias("e")))
    last = F.transform(F.array_distinct(F.transform(placed, lambda x: x["t"])), lambda t: F.array_max(F.filter(placed, lambda x: x["t"] == t)))
    # the list is sorted by turn, as that is the first field
    return F.transform(
        F.array_sort(last),
        lambda x: F.struct(
            x["e"]["turn_idx"].alias("turn_idx"), x["a"].alias("attempt"), x["e"]["rating"].alias("rating"), F.coalesce(x["e"]["explanation"], F.lit("")).alias("explanation"), F.coalesce(x["e"]["success"], F.lit(False)).alias("success")
        ),
    )


def transcript(messages: Column) -> Column:
    """User, assistant and tool messages with their whole texts; an assistant message with tool calls names the tools and is
    marked as an envelope."""
    parsed = F.coalesce(F.from_json(F.when(F.trim(messages).startswith("["), messages), MESSAGES_SCHEMA), F.from_json(F.lit("[]"), MESSAGES_SCHEMA))
    calls = lambda m: F.from_json(m["tool_calls"], "array<struct<name:string,function:struct<name:string>>>")
    named = lambda m: F.array_join(F.transform(calls(m), lambda c: F.coalesce(c["function"]["name"], c["name"], F.lit("tool"))), ", ")
    envelope = lambda m: (m["role"] == "assistant") & (F.coalesce(F.size(calls(m)), F.lit(0)) > 0)
    shown = F.filter(parsed, lambda m: m["role"].isin("user", "assistant", "tool"))
    return F.transform(
        shown,
        lambda m: F.struct(m["role"].alias("role"), F.when(envelope(m), F.concat(F.lit("tool_call: "), named(m))).otherwise(F.coalesce(m["content"], F.lit(""))).alias("content"), envelope(m).alias("tool_envelope")),
    )


def aligned_turns(messages: Column, metadata: Column, first: int = 0) -> Column:
    """The assistant's turns (position in the transcript, turn_idx from ``first``) with the rating that their number has, if any."""
    said = F.filter(F.transform(transcript(messages), lambda m, i: F.struct(i.alias("position"), m.alias("m"))), lambda x: (x["m"]["role"] == "assistant") & ~x["m"]["tool_envelope"])
    ratings = turn_ratings(metadata)
    return F.transform(
        said,
        lambda x, i: F.struct(
            x["position"].alias("position"), (i + first).alias("turn_idx"), x["m"]["content"].alias("content"), F.get(F.filter(ratings, lambda r: r["turn_idx"] == i + first), 0)["rating"].alias("rating")
        ),
    )


def evidence_findings(
    rows: DataFrame, found: DataFrame, capabilities: Sequence[Capability] = CAPABILITIES, *, per_cell: int = 3, cell: str = "assistant_eval", messages: str = "conversation_messages", metadata: str = "conversation_metadata"
) -> DataFrame:
    """(capability, locale, rank, trajectory_id, findings, turns, ratings): of each capability and locale the ``per_cell`` rows
    with the least score, by id where equal, of those below a perfect one.

    ``found`` are ``reporting.evidence`` rows; ``rows`` hold the trajectories' cells, messages and metadata. Only the chosen
    rows' cells are opened.
    """
    worst = first_rows(found.where("row_score < 1").select("capability", "locale", "trajectory_id", "row_score"), ["capability", "locale"], ["row_score", "trajectory_id"], per_cell)
    empty = F.lit(None).cast("string")
    held = rows.select("trajectory_id", F.col(cell).alias("_cell"), *[(F.col(c) if c in rows.columns else empty).alias(a) for c, a in ((messages, "_messages"), (metadata, "_metadata"))])
    chosen = worst.drop("row_score").join(held, "trajectory_id")
    by = F.expr("array()").cast(FINDING)
    for c in capabilities:
        by = F.when(F.col("capability") == c.id, findings(F.col("_cell"), c)).otherwise(by)
    return chosen.select("capability", "locale", "rank", "trajectory_id", by.alias("findings"), aligned_turns(F.col("_messages"), F.col("_metadata")).alias("turns"), turn_ratings(F.col("_metadata")).alias("ratings"))
