"""The supplied tables seen as trajectories, evaluations, turns and runs.

Documents play trajectories (locale = lang, probe_family = source); judge scores
and outcomes are functions of the ids, so the same values exist in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: axis -> (factor, offset): judge a gives 1 + (doc_id * factor + offset) mod 5, judge b one computed with doc_id div 7.
AXES = {"safety": (1, 0), "coherence": (3, 1), "accuracy": (7, 2), "helpfulness": (11, 3), "role_adherence": (13, 4), "language_appropriateness": (17, 1)}


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajectory_id, persona_uuid, locale, probe_family, num_turns, simulation_outcome, doc_id)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    status = F.when(i % 10 == 3, "failed").when(i % 10 == 7, "completed_with_warnings").otherwise("ok")
    outcome = F.to_json(
        F.struct(
            status.alias("status"),
            F.when(i % 10 == 3, F.when(i % 20 == 3, "timeout").otherwise("refusal")).alias("failure_class"),
            F.when(i % 10 == 3, F.when(i % 30 == 3, "user_model").otherwise("assistant")).alias("failure_attribution"),
            (i % 6).cast("int").alias("n_turns"),
            (i % 4).cast("int").alias("n_tool_calls"),
            (i % 50 == 0).cast("int").alias("n_user_role_violations"),
            (i % 9 == 0).alias("early_stop"),
            F.create_map(F.lit("assistant"), i % 3 + 1, F.lit("user"), i % 2 + 1).alias("per_model_calls"),
            F.create_map(F.lit("assistant"), i % 300, F.lit("user"), i % 100).alias("per_model_output_tokens"),
        )
    )
    return d.select(i.cast("string").alias("trajectory_id"), (i % 97).cast("string").alias("persona_uuid"), F.col("lang").alias("locale"), F.col("source").alias("probe_family"), F.lit(2).alias("num_turns"), outcome.alias("simulation_outcome"), i.alias("doc_id"), "n_chars")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trajectory_id, assistant_eval) for the labelled documents; those with toxic = 1 are skipped cells."""
    l = table(spark, sf_dir, "labels").where("quality is not null")
    i = F.col("doc_id")
    judge = lambda score: F.struct(score.cast("double").alias("score"), F.lit("r").alias("reasoning"))
    axes = F.create_map(
        *[x for a, (f, o) in AXES.items() for x in (F.lit(a), F.create_map(F.lit("a"), judge(1 + (i * f + o) % 5), F.lit("b"), judge(1 + (F.expr("doc_id div 7") * f + o) % 5)))]
    )
    block = F.struct(
        F.when(i % 11 == 0, "no turns: scorer skipped").when(i % 13 == 0, "crashed").alias("error"),
        (F.col("quality") == 1).alias("status_proposal"),
        F.create_map(F.lit("shape.empty_or_trivial_rate"), F.when(i % 11 == 0, F.lit(None).cast("string")).otherwise(((i % 5) / 4).cast("string"))).alias("scores"),
    )
    cell = F.to_json(F.struct((F.col("toxic") == 1).alias("skipped"), axes.alias("axes"), F.create_map(F.lit("response_shape"), block).alias("scorers")))
    return l.select(i.cast("string").alias("trajectory_id"), cell.alias("assistant_eval"))


#: The same scores as SQL over ``labels``.
SCORES_SQL = (
    "scored AS (SELECT doc_id, quality, toxic, "
    + ", ".join(f"((1 + (doc_id * {f} + {o}) % 5) + (1 + ((doc_id // 7) * {f} + {o}) % 5)) / 2.0::DOUBLE AS {a}, abs((doc_id * {f} + {o}) % 5 - ((doc_id // 7) * {f} + {o}) % 5) AS {a}_spread" for a, (f, o) in AXES.items())
    + ", CASE WHEN doc_id % 11 = 0 THEN NULL ELSE (doc_id % 5) / 4.0::DOUBLE END AS shape, "
    "CASE WHEN doc_id % 11 = 0 THEN 'not_applicable' WHEN doc_id % 13 = 0 THEN 'error' ELSE 'ok' END AS shape_state "
    "FROM labels WHERE quality IS NOT NULL)"
)
STATUS_SQL = "CASE WHEN doc_id % 10 = 3 THEN 'failed' WHEN doc_id % 10 = 7 THEN 'completed_with_warnings' ELSE 'ok' END"
