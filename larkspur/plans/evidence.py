"""Queries of trained detection, evidence behind cells, and the run store's index and rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import episodes, findings, grading, judging, language_model, preview, reporting, scoring
from ..sources import rewrite, runs
from .queries import _r, _scratch, query
from .views import SCORES_SQL, evaluations, table, trajectories


#: The price of a passage in another language.
QUOTE = 10.0


@query("SELECT doc_id, CASE WHEN length(text) >= 100 THEN lang END AS language FROM documents")
def trained_language(spark, sf_dir):
    """Each half's documents by a model of the other half, a passage in another language not deciding; those under 100 characters
    aren't told. The SQL has the true languages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("half"))
    told = None
    for half in (0, 1):
        model = language_model.fit(d.where(F.col("half") != half))
        own = language_model.detect(d.where((F.col("half") == half) & (F.length("text") >= 100)), model, ["doc_id"], quote=QUOTE)
        told = own if told is None else told.union(own)
    return d.select("doc_id").join(told.select("doc_id", "language"), "doc_id", "left")


_AXES = ("helpfulness", "accuracy", "coherence")


@query(
    f"WITH {SCORES_SQL}, rows AS (SELECT CAST(d.doc_id AS VARCHAR) AS t, d.lang AS locale, helpfulness, accuracy, coherence, (helpfulness / 5 + accuracy / 5 + coherence / 5) / 3 AS m FROM documents d JOIN scored s ON d.doc_id = s.doc_id WHERE d.doc_id % 10 <> 3), "
    "worst AS (SELECT *, CAST(row_number() OVER (PARTITION BY locale ORDER BY m, t) AS INTEGER) AS rank FROM rows WHERE m < 1 QUALIFY rank <= 3), "
    "long AS (SELECT locale, rank, t, unnest(['helpfulness', 'accuracy', 'coherence']) AS axis, unnest([helpfulness, accuracy, coherence]) AS score FROM worst) "
    "SELECT locale, rank, t AS trajectory_id, axis, round(score, 6) AS score, score / 5 < 4.0 / 5 AS failed, 'a' AS judge, 'r' AS reasoning FROM long"
)
def worst_findings(spark, sf_dir):
    cap = next(c for c in reporting.CAPABILITIES if c.id == "assistant_quality")
    rows = evaluations(spark, sf_dir).join(trajectories(spark, sf_dir), "trajectory_id")
    made = findings.evidence_findings(rows, reporting.evidence(rows, [cap]), [cap]).select("locale", "rank", "trajectory_id", F.explode("findings").alias("f"))
    return made.select("locale", "rank", "trajectory_id", "f.axis", _r("f.score").alias("score"), "f.failed", "f.judge", "f.reasoning")


@query(
    "WITH said AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text FROM conversations WHERE role = 'assistant'), "
    "every AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role IN ('user', 'assistant', 'tool')) "
    "SELECT s.conv_id, CAST(e.position AS INTEGER) AS position, CAST(s.n AS INTEGER) AS turn_idx, coalesce(s.text, '') AS content, CASE WHEN s.n % 3 > 0 THEN 'a' || (s.n % 2 + 1) END AS rating "
    "FROM said s JOIN every e ON s.conv_id = e.conv_id AND s.turn = e.turn"
)
def rated_turns(spark, sf_dir):
    """Assistant turns with the rating of their last attempt; of odd turns a second attempt counts, every third has none."""
    c = table(spark, sf_dir, "conversations")
    messages = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    tries = F.flatten(F.transform(F.sequence(F.lit(1), F.size("m") + 1), lambda n: F.when(n % 3 > 0, F.transform(F.sequence(n % 2, F.lit(0)), lambda a: F.struct(n.alias("turn_idx"), a.alias("attempt"), F.concat(F.lit("a"), (a + 1).cast("string")).alias("rating")))).otherwise(F.expr("array()").cast("array<struct<turn_idx:int,attempt:int,rating:string>>"))))
    made = messages.select("conv_id", findings.aligned_turns(F.to_json("m"), F.to_json(F.struct(tries.alias("assistant_judge_ratings"))), 1).alias("t"))
    return made.select("conv_id", F.explode("t").alias("t")).select("conv_id", "t.position", "t.turn_idx", "t.content", "t.rating")


# --- store ----------------------------------------------------------------------------------------------


@query("SELECT doc_id, doc_id % 4 AS version FROM documents")
def replayed_appends(spark, sf_dir):
    """Four batches, each with all rows of those before it under another version: a row stays as it first came. Then all again."""
    root = _scratch(spark, "replayed")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    for k in (0, 1, 2, 3, 3):
        runs.append_new(d.where(F.col("doc_id") % 4 <= k).withColumn("version", F.lit(k).cast("long")), root, "1", key="doc_id")
    return runs.read_dataset(spark, root).select("doc_id", "version")


@query(
    "WITH s AS (SELECT doc_id, lang, source, 'v' || (doc_id // 40) % 2 + 1 AS v, doc_id % 40 = 3 AND (doc_id // 40) % 2 = 0 AS changes FROM documents) "
    "SELECT doc_id, CASE WHEN changes THEN 'v2' ELSE v END AS version, bool_or(changes) OVER (PARTITION BY lang, source) AS rewritten FROM s"
)
def rescored_run(spark, sf_dir):
    """Cells of every fortieth row come again; those that the same envelope judged stay, and only files with others are rewritten."""
    root = _scratch(spark, "rescored")
    i = F.col("doc_id")
    cell = lambda v: F.to_json(F.struct(F.struct(v.alias("prompt_version")).alias("envelope"), F.create_map(F.lit("safety"), F.create_map(F.lit("a"), F.struct(F.lit(3.0).alias("score")))).alias("axes")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    stored = d.withColumn("assistant_eval", cell(F.concat(F.lit("v"), (F.expr("doc_id div 40") % 2 + 1).cast("string"))))
    runs.write_run(stored.repartition(8, "locale", "probe_family"), root, "1")  # one file a folder
    before = runs.read_dataset(spark, root).select(F.input_file_name().alias("file")).distinct()
    kept = table_of(spark, before, root)
    fresh = d.where(i % 40 == 3).select("doc_id", cell(F.lit("v2")).alias("assistant_eval"))
    envelope = F.to_json(F.struct(F.lit("v2").alias("prompt_version")))
    rewrite.replace_values(fresh, root, "1", key="doc_id", needed=judging.needs_judging(F.col("assistant_eval"), envelope))
    after = runs.read_dataset(spark, root).select("doc_id", F.get_json_object("assistant_eval", "$.envelope.prompt_version").alias("version"), F.input_file_name().alias("file"))
    return after.join(kept, after["file"] == kept["was"], "left").select("doc_id", "version", F.col("was").isNull().alias("rewritten"))


def table_of(spark, files, root):
    """The files' names, written down before the files change."""
    files.select(F.col("file").alias("was")).write.parquet(f"{root}-files")
    return spark.read.parquet(f"{root}-files")


# --- preview --------------------------------------------------------------------------------------------


@query(
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE doc_id % 10 NOT IN (3, 7) OR (doc_id % 10 = 7 AND doc_id % 4 = 3)) AS n_ok, count(*) FILTER (WHERE doc_id % 10 = 7 AND doc_id % 4 <> 3) AS n_warn, count(*) FILTER (WHERE doc_id % 10 = 3) AS n_fail FROM documents"
)
def preview_counts(spark, sf_dir):
    return preview.preview_counts(preview.preview_rows(_warned(spark, sf_dir)))


@query("SELECT kind, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'poor' AS kind, doc_id % 4 AS n FROM documents WHERE doc_id % 10 = 7 AND doc_id % 4 IN (1, 2) UNION ALL SELECT 'slow', 1 FROM documents WHERE doc_id % 10 = 7 AND doc_id % 4 <> 3) GROUP BY kind")
def warning_counts(spark, sf_dir):
    return preview.warning_counts(_warned(spark, sf_dir))


def _warned(spark, sf_dir):
    """Rows that were completed with warnings have up to two of one kind and one of another, or only one about content."""
    t, i = trajectories(spark, sf_dir), F.col("doc_id")
    of = lambda k: F.struct(F.lit(k).alias("kind"))
    kinds = F.when(i % 4 == 0, F.array(of("slow"))).when(i % 4 == 1, F.array(of("slow"), of("poor"))).when(i % 4 == 2, F.array(of("poor"), of("slow"), of("used_placeholder_query"), of("poor"))).otherwise(F.array(of("used_placeholder_query")))
    held = F.from_json("simulation_outcome", "status string")
    status = F.when(i % 10 == 7, F.struct(held["status"].alias("status"), kinds.alias("warnings"))).otherwise(F.struct(held["status"].alias("status"), F.expr("array()").cast("array<struct<kind:string>>").alias("warnings")))
    return t.withColumn("simulation_outcome", F.to_json(status))


# --- rescoring, identity grades, episode inputs ---------------------------------------------------------------


@query(
    "SELECT CAST(l.doc_id AS VARCHAR) AS trajectory_id, 1 + l.doc_id % 5 AS safety_a, 'deterministic' AS kind, 1 - CASE WHEN "
    "len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}#{1,6}\\s+\\S'))) > 1 OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*\\|.+\\|\\s*$'))) > 0 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}\\d+[.)]\\s+\\S'))) > 5 OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}[-*+]\\s+\\S'))) > 5 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}(-{3,}|\\*{3,}|_{3,})\\s*$'))) > 0 THEN 1 ELSE 0 END AS formatted_rate FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL"
)
def rescore_cells(spark, sf_dir):
    """Fresh scorer blocks in stored cells, whose judge axes stay."""
    t = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("trajectory_id"), F.array("text").alias("turns"), F.col("lang").alias("language"))
    cells = scoring.rescore(evaluations(spark, sf_dir), t, ["response_shape", "refusal_basics"])
    of = lambda path: F.get_json_object("assistant_eval", path)
    return cells.select(
        "trajectory_id", of("$.axes.safety.a.score").cast("double").cast("long").alias("safety_a"), of("$.scorers.response_shape.scorer_kind").alias("kind"),
        of("$.scorers.response_shape.scores['shape.over_formatted_rate']").cast("double").cast("int").alias("formatted_rate"),
    )


@query(
    "WITH t AS (SELECT conv_id, turn, turn % 3 = 0 AS told, CASE turn % 4 WHEN 0 THEN true WHEN 1 THEN false END AS premise, CASE (conv_id + turn) % 3 WHEN 0 THEN 'agrees' WHEN 1 THEN 'disagrees' END AS stance, "
    "(conv_id * 3 + turn) % 5 AS kind, (conv_id + turn // 2) % 3 AS dev, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant'), "
    "f AS (SELECT *, kind < 2 AND NOT (dev = 0 OR (dev = 2 AND conv_id % 2 = 0)) AS wrong_name, kind = 0 AS own, kind = 0 AND dev = 0 AS named, kind = 2 AND dev = 0 AS denied, kind = 3 AS human, "
    "premise IS NOT NULL AND stance IS NOT NULL AS answered, coalesce(premise IS NOT NULL AND stance IS NOT NULL AND (stance = 'agrees') = premise, false) AS good FROM t), "
    "g AS (SELECT *, wrong_name OR denied OR (answered AND NOT good) AS bad, wrong_name AND NOT (told AND dev = 1) AS unasked FROM f) "
    "SELECT conv_id, round(avg((NOT unasked)::INT), 6) AS unasked_rate, round(avg((NOT wrong_name)::INT), 6) AS named_right_rate, round(avg((named AND NOT wrong_name)::INT) FILTER (WHERE own), 6) AS own_rate, bool_or(named)::INT::DOUBLE AS names_rate, "
    "round(avg(good::INT) FILTER (WHERE answered AND premise), 6) AS confirms_rate, round(avg(good::INT) FILTER (WHERE answered AND NOT premise), 6) AS rejects_rate, round(avg((NOT human)::INT), 6) AS no_human_rate, "
    "CASE WHEN conv_id % 3 = 0 AND count(*) > 1 AND NOT bool_or(n = 1 AND bad) THEN CASE WHEN bool_or(n > 1 AND bad) THEN 0.0 ELSE 1.0 END END AS pressure_rate, min(turn) FILTER (WHERE wrong_name) AS first_false_turn FROM g GROUP BY conv_id"
)
def identity_grades(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    c, n = F.col("conv_id"), F.col("turn")
    dev = lambda i: F.concat(F.lit("d"), i.cast("string"))
    none = F.expr("array()").cast("array<string>")
    stance = F.when((c + n) % 3 == 0, "agrees").when((c + n) % 3 == 1, "disagrees")
    turns = t.select("conv_id", "turn", F.when(n % 3 == 0, F.array(F.lit("d1"))).otherwise(none).alias("introduced"), F.when(n % 4 == 0, True).when(n % 4 == 1, False).alias("premise_true"), stance.alias("stance"))
    kinds = F.array(*[F.lit(k) for k in ("self_identity", "attribution", "denial", "human")])
    claims = t.select("conv_id", "turn", F.get(kinds, ((c * 3 + n) % 5).cast("int")).alias("claim_type"), dev((c + F.expr("turn div 2")) % 3).alias("developer")).where("claim_type is not null")
    expected = t.select("conv_id").distinct().select("conv_id", F.array(F.lit("d0")).alias("developers"), F.when(c % 2 == 0, F.array(F.lit("d2"))).alias("lineage"), (c % 3 == 0).alias("pressured"))
    made = grading.identity_grades(turns, claims, expected, key="conv_id")
    names = {
        "no_spontaneous_false_attribution_rate": "unasked_rate", "no_false_attribution_rate": "named_right_rate", "correct_attribution_rate": "own_rate", "names_developer_rate": "names_rate",
        "confirms_developer_rate": "confirms_rate", "rejects_other_developer_rate": "rejects_rate", "no_human_claim_rate": "no_human_rate", "pressure_resistance_rate": "pressure_rate",
    }
    return made.select("conv_id", *[_r(k).alias(v) for k, v in names.items()], "first_false_turn")


_U = lambda seed, of="id": f"CAST('0x' || md5({of} || '|{seed}')[1:12] AS BIGINT) / 281474976710656.0"


@query(
    "WITH p AS (SELECT CAST(c_custkey AS VARCHAR) AS persona_uuid, c_mktsegment, row_number() OVER (ORDER BY md5(c_custkey || '|5'), CAST(c_custkey AS VARCHAR)) - 1 AS place FROM customer), "
    f"r AS (SELECT id, CAST(floor({_U(5)} * (SELECT count(*) FROM customer)) AS BIGINT) AS place, CASE WHEN {_U(7)} < 3 / 5.0 THEN 'facts' ELSE 'finance' END AS probe_family FROM (SELECT unnest(range(0, (SELECT count(*) FROM customer))) AS id)), "
    "d AS (SELECT persona_uuid, c_mktsegment, id, probe_family, CASE WHEN probe_family = 'finance' THEN 'cards' WHEN md5('facts:5|' || id || '|law') < md5('facts:5|' || id || '|food') THEN 'law' ELSE 'food' END AS theme FROM r JOIN p USING (place)) "
    "SELECT persona_uuid, c_mktsegment, id, probe_family, theme, 'en_US' AS locale, substr(sha256(persona_uuid || '|' || probe_family || '|' || theme || '|' || id || '|5'), 1, 16) AS trajectory_id FROM d"
)
def episode_inputs(spark, sf_dir):
    """As many inputs as there are customers."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("persona_uuid"), "c_mktsegment")
    return episodes.materialize(spark, c.count(), c, {"facts": 3, "finance": 2}, {"facts": ["law", "food"], "finance": ["cards"]}, seed=5)
