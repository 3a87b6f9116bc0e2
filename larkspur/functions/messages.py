"""Rendering and parsing of messages and tool calls."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

# What a dense-script character weighs, and the caps of the two renderings.
DENSE_WEIGHT, PROMPT_CHARS, JUDGE_CHARS = 3, 500, 24_000
# These scripts begin at U+1100; other characters are ruled out by the range before their script is looked up.
_DENSE = r"[\x{1100}-\x{10FFFF}&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]"


def tool_result_weight(text: Column) -> Column:
    """Characters, with Han, kana and Hangul counting as three."""
    return F.length(text) + (DENSE_WEIGHT - 1) * F.regexp_count(text, F.lit(_DENSE))


def cut_tool_result(text: Column, limit: int) -> Column:
    """The text up to a weight, with a note of how much of it is shown."""
    head = F.substring(text, 1, limit)  # a character weighs one at least
    weights = F.transform(F.split(head, ""), lambda c: F.when(c.rlike(_DENSE), DENSE_WEIGHT).otherwise(1))
    step = lambda acc, w: F.when(acc["done"] | (acc["used"] + w > limit), F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(True).alias("done"))).otherwise(
        F.struct((acc["used"] + w).alias("used"), (acc["n"] + 1).alias("n"), F.lit(False).alias("done"))
    )
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    shown = F.when(head.rlike(_DENSE), F.aggregate(weights, start, step)["n"]).otherwise(F.lit(limit))
    note = F.concat(F.lit(" [cut: "), F.format_number(shown, 0), F.lit(" of "), F.format_number(F.length(text), 0), F.lit(" characters shown]"))
    return F.when(tool_result_weight(text) <= limit, text).otherwise(F.concat(F.substring(text, F.lit(1), shown), note))


def render(messages: Column, tool_result_chars: int = PROMPT_CHARS) -> Column:
    """``User:``, ``Assistant:`` and ``Tool response:`` lines; system messages are left out; nothing gives ``N/A``.

    ``messages`` are structs of role and content, and tool_calls as JSON text.
    """
    call = "array<struct<function:struct<name:string,arguments:string>>>"

    def line(m):
        text = F.coalesce(m["content"], F.lit(""))
        calls = F.from_json(m["tool_calls"], call)
        named = F.array_join(F.transform(calls, lambda c: F.concat(F.coalesce(c["function"]["name"], F.lit("?")), F.lit("("), F.coalesce(c["function"]["arguments"], F.lit("{}")), F.lit(")"))), "; ")
        assistant = F.array_compact(F.array(F.when(F.size(calls) > 0, F.concat(F.lit("Assistant [tool calls]: "), named)), F.when(text != "", F.concat(F.lit("Assistant: "), text))))
        return (
            F.when(m["role"] == "user", F.array(F.concat(F.lit("User: "), text)))
            .when(m["role"] == "assistant", assistant)
            .when(m["role"] == "tool", F.array(F.concat(F.lit("Tool response: "), cut_tool_result(text, tool_result_chars))))
            .otherwise(F.expr("array()").cast("array<string>"))
        )

    lines = F.flatten(F.transform(messages, line))
    return F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("N/A")


def public_messages(messages: Column, mark: str = "(after using its tools)") -> Column:
    """User and assistant texts; a reply that directly follows tool results opens with ``mark``."""
    empty = F.expr("array()").cast("array<struct<role:string,content:string>>")
    start = F.struct(empty.alias("out"), F.lit(False).alias("tool"))

    def step(acc, m):
        text = F.coalesce(m["content"], F.lit(""))
        add = lambda c: F.concat(acc["out"], F.array(F.struct(m["role"].alias("role"), c.alias("content"))))
        return (
            F.when(m["role"] == "user", F.struct(add(text).alias("out"), F.lit(False).alias("tool")))
            .when(m["role"] == "tool", F.struct(acc["out"].alias("out"), F.lit(True).alias("tool")))
            .when((m["role"] == "assistant") & (text != ""), F.struct(add(F.when(acc["tool"], F.concat(F.lit(mark + " "), text)).otherwise(text)).alias("out"), F.lit(False).alias("tool")))
            .otherwise(acc)
        )

    return F.aggregate(messages, start, step)["out"]


def theme(raw: Column) -> Column:
    """A theme as type and description: a JSON object, the first of a JSON list, or the plain text as both; a general one without any."""
    kind = "struct<type:string,description:string>"
    general = F.struct(F.lit("general").alias("type"), F.lit("General conversation").alias("description"))
    first = F.get(F.from_json(F.when(F.trim(raw).startswith("["), raw), f"array<{kind}>"), 0)
    whole = F.from_json(F.when(F.trim(raw).startswith("{"), raw), kind)
    return F.when(raw.isNull() | (F.trim(raw) == "[]"), general).otherwise(F.coalesce(first, whole, F.struct(raw.alias("type"), raw.alias("description"))))


def arguments(raw: Column) -> Column:
    """Tool-call arguments as a map of JSON texts; anything but an object is empty."""
    return F.coalesce(F.from_json(F.when(F.trim(raw).startswith("{"), raw), "map<string,string>"), F.create_map().cast("map<string,string>"))


def object_in_text(content: Column) -> Column:
    """The JSON object from the first ``{`` to the last ``}`` of a text as a map; empty where there is none."""
    return arguments(F.regexp_extract(F.coalesce(content, F.lit("")), r"(?s)(\{.*\})", 1))


def canonical_arguments(raw: Column) -> Column:
    """Arguments as JSON with sorted keys, to compare calls."""
    entries = F.array_sort(F.map_entries(arguments(raw)))
    return F.to_json(F.map_from_entries(entries))


def fourth_wall(text: Column, phrases: tuple[str, ...] = ("as an ai", "language model", "i am a bot", "this simulation")) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(low, F.lit(p))
    return out


def judge_reply(text: Column) -> Column:
    """(explanation, rating) of a judge's JSON-like reply; a missing rating is null."""
    rating = F.regexp_extract(text, r'"?rating"?\s*[:=]\s*"?(-?\d+(?:\.\d+)?)', 1)
    explanation = F.regexp_extract(text, r'(?s)"?explanation"?\s*[:=]\s*"((?:[^"\\]|\\.)*)"', 1)
    return F.struct(F.nullif(explanation, F.lit("")).alias("explanation"), rating.try_cast("double").alias("rating"))


# --- tool-call schemas ---------------------------------------------------------------------------------

_KINDS: dict[str, Callable[[Any], bool]] = {
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "array": lambda v: isinstance(v, list),
    "object": lambda v: isinstance(v, dict),
}


def schema_faults(value: Any, schema: Any, at: str = "call") -> Iterator[str]:
    """What is wrong with a JSON value under a schema, place by place: kinds, allowed values, required and closed properties,
    items. Keywords other than type, enum, required, properties, additionalProperties (false) and items ask for nothing."""
    if not isinstance(schema, dict):
        return
    kind = schema.get("type")
    if kind in _KINDS and not _KINDS[kind](value):
        yield f"{at} isn't of type {kind}"
        return
    if isinstance(allowed := schema.get("enum"), list) and value not in allowed:
        yield f"{at} isn't one of the allowed values"
    if isinstance(value, dict):
        known = schema.get("properties") or {}
        yield from (f"{at} lacks {k}" for k in schema.get("required") or () if k not in value)
        for k, v in value.items():
            if k in known:
                yield from schema_faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                yield f"{at} has no place for {k}"
    if isinstance(value, list):
        for i, v in enumerate(value):
            yield from schema_faults(v, schema.get("items"), f"{at}[{i}]")


def call_schema(tools: list, name: Any) -> dict:
    """The schema of a whole call, as an object of name and arguments, where ``tools`` are offered and one of that name is
    called; arguments that the tool doesn't list have no place."""
    functions = [f for t in tools if isinstance(t, dict) and isinstance(f := t.get("tool", t).get("function"), dict)]
    called = next((f.get("parameters") or {} for f in functions if f.get("name") == name), {})
    arguments = {"type": "object", "properties": {}, **called, "additionalProperties": False}
    return {"type": "object", "required": ["name", "arguments"], "properties": {"name": {"enum": [f.get("name") for f in functions]}, "arguments": arguments}}


def call_problem(name: str | None, raw: str | None, tools: str | None) -> str | None:
    """The first fault of one tool call (name, JSON arguments; none are ``{}``) under a JSON list of tool definitions; None without any."""
    try:
        call, offered = {"name": name, "arguments": json.loads(raw or "{}")}, json.loads(tools or "[]")
    except ValueError:
        return "arguments or tools aren't JSON"
    return next(schema_faults(call, call_schema(offered if isinstance(offered, list) else [], name)), None)


def verify_call(name: Column, raw: Column, tools: Column) -> Column:
    """``call_problem`` for each row; JSON schemas nest without bound, so this is a vectorised Python function."""
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def check(n: pd.Series, r: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([call_problem(*x) for x in zip(n, r, t, strict=True)], dtype=object)

    return check(name, raw, tools)


def render_template(template: Column, values: Column) -> Column:
    """``{name}`` placeholders filled from a map; ``{{`` and ``}}`` are braces. A name that the map lacks is an error."""
    # What is filled in isn't looked at again: the template is cut at its placeholders first.
    parts = F.split(F.replace(F.replace(template, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002")), r"[{}]")
    filled = F.transform(
        parts, lambda p, i: F.when(i % 2 == 0, F.translate(p, "\u0001\u0002", "{}")).otherwise(F.coalesce(F.element_at(values, p), F.raise_error(F.concat(F.lit("no value for placeholder "), p)).cast("string")))
    )
    return F.array_join(filled, "")


def fill_slots(text: Column, params: Column) -> Column:
    """``{{slot}}`` markers replaced by the map's values; slots that it lacks stay."""
    parts = F.split(F.regexp_replace(text, r"\{\{\s*(\w+)\s*\}\}", "\u0001$1\u0001"), "\u0001")
    filled = F.transform(parts, lambda p, i: F.when(i % 2 == 0, p).otherwise(F.coalesce(F.element_at(params, p), F.concat(F.lit("{{"), p, F.lit("}}")))))
    return F.array_join(filled, "")


def sampled_params(space: Column, key: Column, seed: int = 0) -> Column:
    """One value for each slot of a map of lists, by the hash of key, slot and seed; slots without values are left out."""
    from .identity import hash_fraction

    some = F.map_filter(space, lambda _, v: F.size(v) > 0)
    return F.transform_values(some, lambda k, v: F.element_at(v, (F.floor(hash_fraction(F.concat_ws("|", key, k), seed=seed) * F.size(v)) + 1).cast("int")))


def run_started(run: Column) -> Column:
    """When a run was started, by its id in seconds: ``2026-11-06 12:02`` in UTC; ``(legacy)`` or ``?`` for others."""
    seconds = F.when(run.rlike("^[0-9]{1,12}$"), run.cast("long"))
    day = F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")
    return F.when(run == "legacy", "(legacy)").otherwise(F.coalesce(day, F.lit("?")))


def simulated_clock(user_messages: Column, minutes: int = 2) -> Column:
    """Noon at the first user message, ``minutes`` more with each after it, 12:59 at most."""
    at = F.least(F.greatest(user_messages - 1, F.lit(0)) * minutes, F.lit(59))
    return F.concat(F.lit("12:"), F.lpad(at.cast("string"), 2, "0"))


def protected_view(persona: dict[str, Column]) -> Column:
    """The religion and language fields that a simulated user was shown, blanks as null."""
    blank = lambda c: F.nullif(F.trim(persona.get(c, F.lit(None)).cast("string")), F.lit(""))
    spoken = F.filter(F.array(*[blank(f"{n}_language") for n in ("first", "second", "third")]), lambda x: x.isNotNull())
    return F.struct(blank("religion").alias("religion"), spoken.alias("languages"), blank("religious_background").alias("religious_background"), blank("linguistic_background").alias("linguistic_background"))
