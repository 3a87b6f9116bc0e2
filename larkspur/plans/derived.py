"""Queries of the report, judging, episode and text operators that are built on others' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, messages
from ..operators import comparison, episodes, judging, reporting
from ..sources import runs
from ..streaming import ingest
from .queries import _CELLS_SQL, _cells, _r, _scratch, query
from .views import table, trajectories

# --- comparison frames ------------------------------------------------------------------------------


@query(f"WITH {_CELLS_SQL} SELECT run_id, locale, count(*) FILTER (WHERE state = 'ready') AS n_ready, count(*) AS n_eligible FROM cells GROUP BY ALL")
def cleared_by_locale(spark, sf_dir):
    return comparison.cleared_counts(_cells(spark, sf_dir), ["locale"])


@query(f"WITH {_CELLS_SQL} SELECT run_id, capability, count(*) FILTER (WHERE state = 'ready') AS n_ready, count(*) AS n_eligible FROM cells GROUP BY ALL")
def cleared_by_capability(spark, sf_dir):
    return comparison.cleared_counts(_cells(spark, sf_dir), ["capability"])


@query(f"WITH {_CELLS_SQL} SELECT run_id, locale, round(avg(score) FILTER (WHERE state IN ('ready', 'blocked')), 6) AS mean_score FROM cells GROUP BY ALL")
def locale_means(spark, sf_dir):
    return comparison.locale_means(_cells(spark, sf_dir)).withColumn("mean_score", _r("mean_score"))


@query(
    f"WITH {_CELLS_SQL}, limited AS (SELECT *, CASE WHEN capability LIKE '%/F' THEN 0.76 ELSE 0.5 END AS threshold, capability LIKE '1-%' AND locale LIKE 'A%' AS must FROM cells WHERE state IN ('ready', 'blocked')), "
    "means AS (SELECT run_id, capability, count(*) AS n_locales, count(*) FILTER (WHERE must) AS n_failed, avg(score) AS m, avg(threshold) AS t FROM limited GROUP BY ALL) "
    "SELECT run_id, capability, n_locales, n_failed, round(m, 6) AS mean_score, CASE WHEN n_failed > 0 THEN 'blocked' WHEN m >= t THEN 'ready' ELSE 'blocked' END AS state FROM means"
)
def overall_cells(spark, sf_dir):
    """Single locales are blocked under 0.75; the mean over them has thresholds of its own, and a must-pass axis failed in some."""
    must = F.col("capability").startswith("1-") & F.col("locale").startswith("A")
    cells = _cells(spark, sf_dir).withColumns({"threshold": F.when(F.col("capability").endswith("/F"), 0.76).otherwise(0.5), "failed_axes": F.when(must, F.array(F.lit("safety")))})
    return comparison.overall_cells(cells).withColumn("mean_score", _r("mean_score"))


@query(
    f"WITH {_CELLS_SQL}, loc AS (SELECT run_id, locale, count(*) AS n, count(*) FILTER (WHERE state = 'ready') AS r, avg(score) FILTER (WHERE state IN ('ready', 'blocked')) AS m FROM cells GROUP BY ALL), "
    "runs AS (SELECT run_id, sum(n)::BIGINT AS n_eligible, sum(r)::BIGINT AS n_ready, sum(r) / sum(n) AS cleared, avg(m) AS mean_score FROM loc GROUP BY run_id) "
    "SELECT run_id, n_ready, n_eligible, round(cleared, 6) AS cleared, round(mean_score, 6) AS mean_score, CAST(row_number() OVER (ORDER BY cleared DESC, mean_score DESC NULLS LAST, run_id) AS INTEGER) AS place FROM runs"
)
def leaderboard(spark, sf_dir):
    return comparison.leaderboard(_cells(spark, sf_dir)).withColumns({"cleared": _r("cleared"), "mean_score": _r("mean_score")})


@query(
    f"WITH {_CELLS_SQL} SELECT capability, locale, count(*) FILTER (WHERE state = 'ready') AS n_ready, count(*) FILTER (WHERE state IN ('ready', 'blocked')) AS n_measured, count(DISTINCT run_id) AS n_runs FROM cells GROUP BY ALL"
)
def heatmap(spark, sf_dir):
    return comparison.heatmap(_cells(spark, sf_dir))


# --- report -------------------------------------------------------------------------------------------


def _envelopes(spark, sf_dir):
    i = F.col("doc_id")
    aliases = F.array(F.lit("a"), F.concat(F.lit("j"), (i % 3).cast("string")))
    models = F.array(F.concat(F.lit("m"), (i % 4).cast("string")), F.lit("n"))
    envelope = F.struct(F.when(i % 5 > 0, F.concat(F.lit("v"), (i % 2).cast("string"))).alias("prompt_version"), aliases.alias("judge_aliases"), models.alias("judge_models"))
    return table(spark, sf_dir, "labels").select(F.to_json(F.struct(envelope.alias("envelope"))).alias("assistant_eval"))


@query(
    "SELECT alias, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM (SELECT 'a' AS alias, 'm' || (doc_id % 4) AS model FROM labels UNION ALL SELECT 'j' || (doc_id % 3), 'n' FROM labels) GROUP BY alias"
)
def evaluator_models(spark, sf_dir):
    return reporting.evaluator_models(_envelopes(spark, sf_dir)).withColumn("models", F.array_join("models", ","))


@query("SELECT DISTINCT 'v' || (doc_id % 2) AS prompt_version FROM labels WHERE doc_id % 5 > 0")
def evaluator_prompt_versions(spark, sf_dir):
    return reporting.evaluator_prompt_versions(_envelopes(spark, sf_dir))


@query(
    "WITH p AS (SELECT 'assistant' AS alias, sum(doc_id % 3 + 1) AS calls, 0 AS i, sum(doc_id % 300) AS o, sum(doc_id % 7) AS r FROM documents UNION ALL SELECT 'user', sum(doc_id % 2 + 1), 0, sum(doc_id % 100), 0 FROM documents), "
    "e AS (SELECT * FROM p UNION ALL SELECT 'total', sum(calls), sum(i), sum(o), sum(r) FROM p) "
    "SELECT alias, calls::BIGINT AS calls, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, r::BIGINT AS reasoning_tokens, greatest(o - r, 0)::BIGINT AS conversation_tokens, (i + o)::BIGINT AS total_tokens FROM e"
)
def resource_totals(spark, sf_dir):
    rows = trajectories(spark, sf_dir)
    hidden = rows.agg(F.sum(F.col("doc_id") % 7).alias("reasoning_tokens")).select(F.lit("assistant").alias("alias"), "reasoning_tokens")
    return reporting.resource_totals(reporting.resource_profile(rows), hidden)


@query("SELECT role AS alias, CAST(ceil(sum(len(string_split_regex(trim(text), '\\s+'))) * 4 / 3) AS BIGINT) AS visible_tokens FROM conversations WHERE trim(text) <> '' GROUP BY role")
def visible_tokens(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("alias"), "text")
    return reporting.visible_tokens(turns)


@query(
    "SELECT lang, array_to_string(list(CASE WHEN length(text) > 40 THEN text[1:39] || '…' ELSE text END ORDER BY doc_id), '|') AS snippets "
    "FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE text IS NOT NULL) WHERE r <= 3 GROUP BY lang"
)
def snippets(spark, sf_dir):
    made = reporting.snippets(table(spark, sf_dir, "documents"), ["lang"], key="doc_id", text="text", length=40)
    return made.select("lang", F.array_join("snippets", "|").alias("snippets"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'm' || doc_id % 4 WHEN doc_id % 3 = 1 THEN 'x' END AS model, CASE WHEN doc_id % 3 = 0 THEN 'manifest' WHEN doc_id % 3 = 1 THEN 'explicit_kwarg' ELSE 'unknown' END AS source FROM labels"
)
def run_model(spark, sf_dir):
    i = F.col("doc_id")
    made = reporting.model_of(F.when(i % 3 == 0, F.concat(F.lit("m"), (i % 4).cast("string"))), F.when(i % 3 == 1, F.lit("x")))
    return table(spark, sf_dir, "labels").select("doc_id", made.alias("m")).select("doc_id", "m.model", "m.source")


# --- judging --------------------------------------------------------------------------------------------

_ITEMS_SQL = """items AS (
    SELECT doc_id // 5 AS t, 'f' || (doc_id % 5) AS item, CASE WHEN doc_id % 7 > 0 THEN (doc_id % 5 + 1)::DOUBLE END AS a, CASE WHEN doc_id % 2 > 0 THEN (doc_id % 3 + 2)::DOUBLE END AS b FROM documents),
long AS (SELECT t, item, 'accuracy' AS axis, a AS s FROM items UNION ALL SELECT t, item, 'grounding', b FROM items)"""


@query(
    f"WITH {_ITEMS_SQL}, low AS (SELECT *, min(s) OVER (PARTITION BY t, axis) AS m FROM long) SELECT t, axis, count(s) AS n, round(avg(s), 3) AS score, "
    "coalesce(array_to_string(list_sort(list(item) FILTER (WHERE s = m)), ','), '') AS lowest FROM low GROUP BY t, axis"
)
def item_means(spark, sf_dir):
    i = F.col("doc_id")
    scores = F.create_map(F.lit("accuracy"), F.when(i % 7 > 0, (i % 5 + 1).cast("double")), F.lit("grounding"), F.when(i % 2 > 0, (i % 3 + 2).cast("double")))
    entries = table(spark, sf_dir, "documents").select(F.expr("doc_id div 5").alias("t"), F.concat(F.lit("f"), (i % 5).cast("string")).alias("item_id"), scores.alias("scores"))
    return judging.item_means(entries, "t", ["accuracy", "grounding"]).withColumn("lowest", F.array_join("lowest", ","))


def _scored_docs(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(i.alias("id"), F.when(i % 6 > 0, (i % 5 + 1).cast("string")).otherwise("n/a").alias("faithfulness"), ((i % 4) + 2).cast("string").alias("fluency"))


@query(
    "SELECT round(avg(CASE WHEN doc_id % 6 > 0 THEN doc_id % 5 + 1 END), 6) AS mean_faithfulness, round(avg(doc_id % 4 + 2), 6) AS mean_fluency, count(*) AS n_docs, "
    "count(*) FILTER (WHERE (doc_id % 6 > 0 AND doc_id % 5 + 1 < 3) OR doc_id % 4 + 2 < 3) AS n_low FROM documents"
)
def scorecard(spark, sf_dir):
    total = judging.scorecard(_scored_docs(spark, sf_dir), ["faithfulness", "fluency"])[1]
    return total.withColumns({c: _r(c) for c in ("mean_faithfulness", "mean_fluency")})


@query("SELECT doc_id AS id FROM documents WHERE (doc_id % 6 = 0 OR doc_id % 5 + 1 >= 3) AND doc_id % 4 + 2 >= 3")
def usable_rows(spark, sf_dir):
    docs = judging.scorecard(_scored_docs(spark, sf_dir), ["faithfulness", "fluency"])[0]
    return judging.usable(docs, ["faithfulness", "fluency"]).select("id")


@query(
    "WITH a AS (SELECT DISTINCT (['safety', 'cultural_sensitivity', 'language_appropriateness', 'accuracy', 'coherence', 'role_adherence', 'shape.truncation_suspicion_rate', 'safety_' || lang])[doc_id % 8 + 1] AS axis FROM documents) "
    "SELECT axis, CASE WHEN axis IN ('accuracy', 'coherence') THEN 'quality' WHEN axis = 'role_adherence' OR contains(axis, '.') OR starts_with(axis, 'safety_') THEN 'probe_outcome' ELSE 'guardrail' END AS category FROM a WHERE axis IS NOT NULL"
)
def axis_categories(spark, sf_dir):
    names = [F.lit(x) for x in ("safety", "cultural_sensitivity", "language_appropriateness", "accuracy", "coherence", "role_adherence", "shape.truncation_suspicion_rate")]
    axes = table(spark, sf_dir, "documents").select(F.get(F.array(*names, F.concat(F.lit("safety_"), "lang")), (F.col("doc_id") % 8).cast("int")).alias("axis")).distinct()
    return axes.where("axis is not null").withColumn("category", judging.axis_category(F.col("axis")))


@query("SELECT DISTINCT lang AS axis FROM documents WHERE lang IN ('en', 'de')")
def chosen_axes(spark, sf_dir):
    axes = table(spark, sf_dir, "documents").select(F.col("lang").alias("axis")).distinct()
    families = F.when(F.col("axis") == "fr", F.array(F.lit("other"))).when(F.col("axis") == "en", F.array(F.lit("facts")))
    return judging.choose_axes(axes.withColumn("probe_families", families), "facts", ["en", "de"]).select("axis")


# --- episodes and banks -------------------------------------------------------------------------------


@query("SELECT doc_id, source AS topic, doc_id % 3 AS turns FROM documents")
def unpacked_episodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    packed = d.select("doc_id", F.lit("old").alias("topic"), F.struct(F.col("source").alias("topic"), (F.col("doc_id") % 3).alias("turns")).alias("episode"))
    return episodes.unpack(packed)


def _banks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and source is not null")
    clusters = d.groupBy("lang", "source").agg(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")).alias("documents"))
    return clusters.groupBy(F.col("lang").alias("institution_id")).agg(F.collect_list(F.struct(F.col("source").alias("kind"), "documents")).alias("clusters"))


@query(
    "SELECT lang AS institution_id, source AS cluster_kind, CAST(row_number() OVER w - 1 AS INTEGER) AS position, CAST((row_number() OVER w - 1) // 4 AS INTEGER) AS batch, CAST(doc_id AS VARCHAR) AS document_type "
    "FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)"
)
def exploded_institutions(spark, sf_dir):
    return episodes.explode_institutions(_banks(spark, sf_dir))


@query("SELECT lang AS institution_id, count(DISTINCT doc_id % 50) AS n_documents FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang")
def regrouped_institutions(spark, sf_dir):
    docs = episodes.explode_institutions(_banks(spark, sf_dir)).withColumn("document_id", F.col("document_type").cast("long") % 50)
    return episodes.regroup_institutions(docs).select("institution_id", "n_documents")


# --- names, templates and clocks ------------------------------------------------------------------------


@query(
    "WITH h AS (SELECT page_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages) SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || "
    "['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS id FROM h"
)
def page_uuid5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.uuid5(F.col("url")).alias("id"))


@query("SELECT c_custkey, sha256('{\"locale\":\"' || c_nationkey || '\",\"seed\":\"' || c_custkey % 3 || '\"}') AS fingerprint FROM customer")
def setup_fingerprints(spark, sf_dir):
    made = identity.setup_fingerprint(seed=F.col("c_custkey") % 3, locale=F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("fingerprint"))


@query("SELECT c_custkey, 'deepseek model ' || lower(c_mktsegment) AS name FROM customer")
def folded_names(spark, sf_dir):
    name = F.concat(F.lit(" ＤｅｅｐＳｅｅｋ​　 Model "), F.col("c_mktsegment"), F.lit("﻿"))
    return table(spark, sf_dir, "customer").select("c_custkey", identity.fold_name(name).alias("name"))


@query(
    "SELECT DISTINCT id AS model_id, CASE WHEN id = 'org/Brand#13:x' THEN 'exact' WHEN regexp_matches(lower(id), '^org/brand#1.*$') THEN 'ones' WHEN regexp_matches(lower(id), '(^|[/:@.-])brand#2.:x$') THEN 'twos' END AS developer "
    "FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'org/' ELSE '' END || p_brand || ':x' AS id FROM part)"
)
def model_developers(spark, sf_dir):
    models = table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "org/").otherwise(""), "p_brand", F.lit(":x")).alias("model_id"))
    rules = spark.createDataFrame([(1, "org/brand#1*", "ones"), (2, "Brand#2?:x", "twos"), (3, "org/Brand#13:x", "exact")], "place int, pattern string, developer string")
    return identity.matched_rule(models, rules).select("model_id", "developer")


@query("SELECT c_custkey, 'Dear ' || c_name || ' {of} ' || c_mktsegment AS text FROM customer")
def rendered_templates(spark, sf_dir):
    values = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", messages.render_template(F.lit("Dear {name} {{of}} {segment}"), values).alias("text"))


@query("SELECT c_custkey, 'Move ' || c_custkey || ' to {{other}}' AS text FROM customer")
def filled_slots(spark, sf_dir):
    params = F.create_map(F.lit("amount"), F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", messages.fill_slots(F.lit("Move {{ amount }} to {{other}}"), params).alias("text"))


@query(
    "SELECT c_custkey, ['10', '20', '30'][CAST(floor(CAST('0x' || md5(c_custkey || '|amount|0')[1:12] AS BIGINT) / 281474976710656.0 * 3) AS INTEGER) + 1] AS amount FROM customer"
)
def sampled_params(spark, sf_dir):
    space = F.create_map(F.lit("amount"), F.array(F.lit("10"), F.lit("20"), F.lit("30")), F.lit("none"), F.expr("array()").cast("array<string>"))
    made = messages.sampled_params(space, F.col("c_custkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.element_at(made, "amount").alias("amount"))


@query("SELECT DISTINCT o_custkey, CASE WHEN o_custkey % 9 = 0 THEN '(legacy)' WHEN o_custkey % 9 = 1 THEN '?' ELSE strftime(to_timestamp(1700000000 + o_custkey * 1000)::TIMESTAMP, '%Y-%m-%d %H:%M') END AS started FROM orders")
def runs_started(spark, sf_dir):
    i = F.col("o_custkey")
    run = F.when(i % 9 == 0, "legacy").when(i % 9 == 1, "x1").otherwise((i.cast("long") * 1000 + 1700000000).cast("string"))
    return table(spark, sf_dir, "orders").select("o_custkey", messages.run_started(run).alias("started")).distinct()


@query("SELECT conv_id, turn, '12:' || lpad(CAST(least(greatest(turn - 1, 0) * 2, 59) AS VARCHAR), 2, '0') AS clock FROM conversations")
def simulated_clock(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", messages.simulated_clock(F.col("turn")).alias("clock"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS religion, CASE WHEN c_custkey % 2 = 0 THEN 'a,' ELSE '' END || 'c' AS languages FROM customer"
)
def protected_view(spark, sf_dir):
    i = F.col("c_custkey")
    fields = {"religion": F.when(i % 3 > 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(" "), "first_language": F.when(i % 2 == 0, "a"), "second_language": F.lit(""), "third_language": F.lit("c")}
    made = table(spark, sf_dir, "customer").select("c_custkey", messages.protected_view(fields).alias("v"))
    return made.select("c_custkey", "v.religion", F.array_join("v.languages", ",").alias("languages"))


# --- store and streams ----------------------------------------------------------------------------------


def _stored(spark, sf_dir, name: str) -> str:
    """Two runs of one dataset: all documents with even ids, then a third of all with another version."""
    root = _scratch(spark, name)
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    runs.write_run(d.where("doc_id % 2 = 0").withColumn("version", F.lit("first")).coalesce(2), root, "1")
    runs.publish_new_run(d.where("doc_id % 3 = 0").withColumn("version", F.lit("second")).coalesce(2), root, "1")
    return root


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'first' ELSE 'second' END AS version FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")
def loaded_runs(spark, sf_dir):
    """Several runs, each id from the first that has it; the second run took the next free number."""
    return runs.load_runs(spark, _stored(spark, sf_dir, "loaded"), ["1", "2"], key="doc_id").select("doc_id", "version")


@query("SELECT doc_id, 'first' AS version, '1' AS run FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'second', '2' FROM documents WHERE doc_id % 3 = 0")
def all_runs(spark, sf_dir):
    return runs.read_dataset(spark, _stored(spark, sf_dir, "all"), run="all").select("doc_id", "version", "run")


@query("SELECT DISTINCT lang AS locale FROM documents WHERE lang IS NOT NULL")
def stored_locales(spark, sf_dir):
    root = _stored(spark, sf_dir, "locales")
    return spark.createDataFrame([(x,) for x in runs.partition_values(runs.read_dataset(spark, root, run="all"), "locale")], "locale string")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'third' END AS version FROM documents")
def appended_rows(spark, sf_dir):
    """Rows with new ids join a run; those it has stay as they were."""
    root = _stored(spark, sf_dir, "appended")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    runs.append_new(d.withColumn("version", F.lit("third")).coalesce(2), root, "2", key="doc_id")
    return runs.read_dataset(spark, root, run="2").select("doc_id", "version")


@query("SELECT event_id, event_type FROM events")
def unique_events(spark, sf_dir):
    """A stream in which every event comes twice; a watermark bounds how long copies are remembered."""
    source, out = f"{sf_dir}/events.parquet", _scratch(spark, "unique")
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir) if not runs.is_folder(spark, source) else spark.readStream.schema(schema).parquet(source)
    stream = stream.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    once = ingest.unique_events(stream, key="event_id", time="ts", delay="1 hour")
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("event_id", "event_type")
