"""The parts of a simulated conversation: a model loop with an injected client, and ordered folds over its log."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import hash_fraction
from ..shipping import ship

Reply = Callable[[dict], dict]


def converse(rows: DataFrame, make_client: Callable[[], Reply], schema: str) -> DataFrame:
    """Run each row through a client made once for a partition; a row that fails comes back with ``status`` failed and the reason.

    ``schema`` names the client's fields; ``status`` and ``failure_detail`` are added.
    """
    ship(rows.sparkSession)
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                try:
                    made = client(row)
                    out.append({**{n: made.get(n) for n in names}, "status": "ok", "failure_detail": None})
                except Exception as e:  # noqa: BLE001  one row's failure is its result
                    out.append({**dict.fromkeys(names), "status": "failed", "failure_detail": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out, columns=[*names, "status", "failure_detail"])

    return rows.mapInPandas(run, f"{schema}, status string, failure_detail string")


def translate_distinct(rows: DataFrame, text: str, translate: Callable[[list[str]], list[str]], out: str = "translated") -> DataFrame:
    """Each distinct text is translated once and joined back."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({text: batch[text], out: translate(batch[text].tolist())})

    distinct = rows.select(text).where(F.col(text).isNotNull()).distinct()
    return rows.join(distinct.mapInPandas(run, f"`{text}` string, `{out}` string"), text, "left")


def compress_history(messages: Column, summaries: Column, window: int = 1) -> Column:
    """Messages (role, content) with those that have a summary (map: position from 0) replaced by it, but for the last ``window`` of them."""
    if window < 1:
        raise ValueError("window must be at least 1")
    places = F.array_sort(F.map_keys(summaries))
    old = F.slice(places, 1, F.greatest(F.size(places) - window, F.lit(0)))
    short = lambda i: F.concat(F.lit("[Summary of previous response: "), F.element_at(summaries, i), F.lit("]"))
    return F.transform(messages, lambda m, i: F.when(F.array_contains(old, i), F.struct(m["role"].alias("role"), short(i).alias("content"))).otherwise(F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def draw_tools(rows: DataFrame, tools: DataFrame, n: int, *, key: str = "trajectory_id", seed: int = 0) -> DataFrame:
    """``n`` tools of the row's toolset (toolset, tool) for each row, by hash."""
    pairs = rows.select(key, "toolset").join(tools, "toolset")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(hash_fraction(F.col(key), F.col("tool"), seed=seed), "tool"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= n).drop("toolset")


def earlier_calls(calls: DataFrame, *, key: str = "trajectory_id") -> DataFrame:
    """Calls (key, call_no, name, arguments as canonical JSON) with the number of the first equal call before them, or null."""
    first = F.min("call_no").over(Window.partitionBy(key, "name", "arguments"))
    return calls.withColumn("same_as", F.when(first < F.col("call_no"), first))


def outcomes(events: DataFrame, *, key: str = "trajectory_id") -> DataFrame:
    """Outcome records from trace events (key, seq, kind, alias, input_tokens, output_tokens, seconds, detail).

    ``call`` events sum by model alias, ``warning`` events are kept in order, a
    ``failure`` gives the status failed (its detail is ``class:attribution``, the last one counts).
    """
    kind = F.col("kind")
    by_alias = events.where(kind == "call").groupBy(key, "alias").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("seconds").alias("s"))
    maps = by_alias.groupBy(key).agg(*[F.map_from_entries(F.array_sort(F.collect_list(F.struct("alias", c)))).alias(name) for c, name in (("n", "per_model_calls"), ("i", "per_model_input_tokens"), ("o", "per_model_output_tokens"), ("s", "wall_clock_s_by_alias"))])
    rest = events.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(kind == "warning", F.struct("seq", "detail")))).alias("_w"),
        F.max_by("detail", F.when(kind == "failure", F.col("seq"))).alias("_f"),
        F.count_if(kind == "failure").alias("_nf"),
        F.count_if(kind == "turn").alias("n_turns"),
    )
    failed = F.col("_nf") > 0
    out = rest.join(maps, key, "left")
    return out.select(
        key,
        F.when(failed, "failed").when(F.size("_w") > 0, "completed_with_warnings").otherwise("ok").alias("status"),
        F.when(failed, F.split_part("_f", F.lit(":"), F.lit(1))).alias("failure_class"),
        F.when(failed, F.split_part("_f", F.lit(":"), F.lit(2))).alias("failure_attribution"),
        "n_turns",
        F.transform("_w", lambda w: w["detail"]).alias("warnings"),
        "per_model_calls",
        "per_model_input_tokens",
        "per_model_output_tokens",
        "wall_clock_s_by_alias",
    )


# --- ordered folds of state: one conversation at a time, so groupBy().applyInPandas() ----------------------

# How far a conversation must be for full disclosure, for risk signals and for an open reveal.
DISCLOSURE_GATE, RISK_GATE, REVEAL_GATE = 0.35, 0.70, 0.80
RISK_MOVES = ("hint_risk", "reveal_risk")


def guard_moves(moves: DataFrame, *, key: str = "trajectory_id", schema_key: str = "string") -> DataFrame:
    """Accept or veto each proposed move (key, turn, num_turns, archetype, move, topic) by pacing and what was told before.

    Adds ``accepted`` and ``reason``. Vetoed moves change nothing; a topic told in full can't be told again.
    """
    ship(moves.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        told: set[str] = set()
        accepted, reasons = [], []
        pdf = pdf.sort_values(["turn", "move", "topic"], na_position="first")
        for turn, total, archetype, move, topic in zip(pdf["turn"], pdf["num_turns"], pdf["archetype"], pdf["move"], pdf["topic"], strict=True):
            arc = turn / (total - 1) if total > 1 else 1.0
            reason = "ok"
            if move == "reveal_risk" and archetype == "covert_risk" and arc < REVEAL_GATE:
                reason = "revealed too early"
            elif move in RISK_MOVES and arc < RISK_GATE:
                reason = "risk too early"
            elif move == "disclose" and arc < DISCLOSURE_GATE:
                reason = "disclosed too early"
            elif move == "disclose" and topic in told:
                reason = "told already"
            if reason == "ok" and move == "disclose" and topic:
                told.add(topic)
            accepted.append(reason == "ok")
            reasons.append(reason)
        return pdf.assign(accepted=accepted, reason=reasons)[[key, "turn", "move", "topic", "accepted", "reason"]]

    return moves.groupBy(key).applyInPandas(run, f"{key} {schema_key}, turn int, move string, topic string, accepted boolean, reason string")
