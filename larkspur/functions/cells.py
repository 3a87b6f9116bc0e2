"""Evaluation cells and outcome records: tolerant parsing into typed columns, and their scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JUDGE = "struct<score:double,reasoning:string>"
CELL_SCHEMA = (
    f"skipped boolean, skipped_reason string, axes map<string,map<string,{JUDGE}>>, "
    "scorers map<string,struct<status_proposal:boolean,error:string,scores:map<string,string>>>, "
    "envelope struct<judge_aliases:array<string>,judge_models:array<string>,axes:array<string>,scorers:array<string>,prompt_version:string,evaluator_version:string>"
)
# The counters of an outcome record.
COUNTERS = (
    "n_turns n_tool_calls n_user_query_attempts n_user_followup_retries n_user_language_violations n_assistant_inline_failures "
    "n_assistant_retries n_assistant_ungrounded n_api_response_rerolls n_api_response_rejections n_fourth_wall_triggers n_user_role_violations"
).split()
OUTCOME_SCHEMA = (
    "status string, failure_class string, failure_attribution string, failure_detail string, early_stop boolean, "
    + ", ".join(f"{c} int" for c in COUNTERS)
    + ", warnings array<struct<kind:string,turn_idx:int,detail:string>>, per_model_calls map<string,bigint>, per_model_input_tokens map<string,bigint>, "
    "per_model_output_tokens map<string,bigint>, wall_clock_s_by_alias map<string,double>, wall_clock_s double, "
    "provenance struct<scenario_prompt_version:string,code_sha:string,bank_version:map<string,string>>"
)
MESSAGES_SCHEMA = "array<struct<role:string,content:string,tool_calls:string>>"
# Axis name prefixes (and the suffix) of scores between 0 and 1.
RATE_PREFIXES, RATE_SUFFIX = ("language.", "shape.", "refusal."), "_rate"


def parse_cell(text: Column) -> Column:
    """A struct, or null for a missing or undecodable cell."""
    return F.from_json(F.when(F.trim(text).startswith("{"), text), CELL_SCHEMA)


def parse_outcome(text: Column) -> Column:
    return F.from_json(F.when(F.trim(text).startswith("{"), text), OUTCOME_SCHEMA)


def parse_messages(text: Column) -> Column:
    """The messages, [] for a missing or undecodable list."""
    return F.coalesce(F.from_json(F.when(F.trim(text).startswith("["), text), MESSAGES_SCHEMA), F.from_json(F.lit("[]"), MESSAGES_SCHEMA))


def is_rate(axis: Column) -> Column:
    """Whether an axis name says a score between 0 and 1; all others are 1 to 5."""
    out = axis.endswith(RATE_SUFFIX)
    for p in RATE_PREFIXES:
        out = out | axis.startswith(p)
    return out


def normalized(axis: Column, score: Column) -> Column:
    """1-5 scores over 5, rates as they are (so the lowest judge score is 0.2)."""
    return F.when(is_rate(axis), score).otherwise(score / 5)


def number_in(value: Column) -> Column:
    """A score that is stored as ``{"score": x}`` or as a bare number; NaN and everything else is null."""
    plain = value.try_cast("double")
    found = F.coalesce(F.get_json_object(value, "$.score").try_cast("double"), plain)
    return F.nanvl(found, F.lit(None).cast("double"))


def judge_scores(cell: Column, axis: Column) -> Column:
    """All judges' scores of an axis, nulls and NaN left out."""
    judges = F.coalesce(F.map_values(F.element_at(cell["axes"], axis)), F.array().cast(f"array<{JUDGE}>"))
    return F.filter(F.transform(judges, lambda j: F.nanvl(j["score"], F.lit(None).cast("double"))), lambda s: s.isNotNull())


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values))


def axis_score(cell: Column, axis: Column) -> Column:
    """The ensemble's mean for a judge axis, else the scorers' own score of that name."""
    from_scorers = F.filter(
        F.transform(F.coalesce(F.map_values(cell["scorers"]), F.expr("array()")), lambda s: number_in(F.element_at(s["scores"], axis))), lambda s: s.isNotNull()
    )
    return F.coalesce(_mean(judge_scores(cell, axis)), F.get(from_scorers, 0))


def scorer_state(block: Column) -> Column:
    """ok, error or not_applicable (an error text that begins ``no `` and says that the scorer was skipped); null without a block."""
    error = block["error"]
    skip = F.lower(error).startswith("no ") & F.contains(F.lower(error), F.lit("scorer skipped"))
    return F.when(block.isNull(), F.lit(None).cast("string")).when(error.isNull() | (error == ""), "ok").when(skip, "not_applicable").otherwise("error")
