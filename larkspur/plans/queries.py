"""Every operator applied to the supplied tables, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, languages, locales, messages, persona, text
from ..operators import bank_checks, comparison, dialogue, episodes, grading, judging, manifest, reporting, retrieval, sampling, scoring, selection, simulation
from .views import SCORES_SQL, STATUS_SQL, evaluations, table, trajectories

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- selection ----------------------------------------------------------------------------------

_FLOORS = ("safety", "coherence", "accuracy", "role_adherence", "language_appropriateness")
_AXES = (*_FLOORS, "helpfulness")
_LOW = " ".join(f"WHEN {a} < 2.0 THEN '{a}'" for a in ("safety", "coherence", "role_adherence", "language_appropriateness", "accuracy"))
_MEAN = "(" + " + ".join(f"{a} / 5" for a in ("accuracy", "coherence", "helpfulness", "language_appropriateness", "role_adherence", "safety")) + ") / 6"
_GATED_SQL = f"""{SCORES_SQL}, gated AS (
    SELECT CAST(d.doc_id AS VARCHAR) AS trajectory_id, d.doc_id, d.lang AS locale, d.source AS probe_family,
           CASE WHEN s.doc_id IS NULL THEN 'no_eval' WHEN s.toxic = 1 THEN 'skipped'
                WHEN d.doc_id % 10 = 3 THEN 'status' WHEN d.doc_id % 6 < 1 THEN 'min_turns'
                {_LOW} WHEN shape < 0.5 THEN 'shape.empty_or_trivial_rate' END AS drop_reason,
           CASE WHEN s.toxic = 0 THEN {_MEAN} END AS quality
    FROM documents d LEFT JOIN scored s ON d.doc_id = s.doc_id)"""


def _verdicts(spark: SparkSession, sf_dir: str, profile=selection.GENEROUS) -> DataFrame:
    return selection.select_trajectories(trajectories(spark, sf_dir), evaluations(spark, sf_dir), profile=profile)[1]


@query("SELECT d.doc_id, l.doc_id IS NULL AS no_eval FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.quality IS NOT NULL")
def select_left_join(spark, sf_dir):
    t, e = trajectories(spark, sf_dir), evaluations(spark, sf_dir)
    return selection.attach(t, e, "trajectory_id", ["assistant_eval"]).select("doc_id", F.isnull("assistant_eval").alias("no_eval"))


@query(f"WITH {_GATED_SQL} SELECT trajectory_id, drop_reason IS NULL AS passed, drop_reason, round(quality, 6) AS quality FROM gated")
def select_gate_reasons(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("trajectory_id", F.col("selection_passed").alias("passed"), F.col("selection_drop_reason").alias("drop_reason"), _r("selection_quality_score").alias("quality"))


@query(
    f"WITH {_GATED_SQL} SELECT 'total' AS kind, CASE WHEN drop_reason IS NULL THEN 'passed' ELSE 'dropped' END AS name, count(*) AS n FROM gated GROUP BY ALL "
    "UNION ALL SELECT 'drop_reason', drop_reason, count(*) FROM gated WHERE drop_reason IS NOT NULL GROUP BY ALL "
    "UNION ALL SELECT 'kept', locale || '/' || probe_family, count(*) FROM gated WHERE drop_reason IS NULL GROUP BY ALL"
)
def select_funnel(spark, sf_dir):
    curated, every = selection.select_trajectories(trajectories(spark, sf_dir), evaluations(spark, sf_dir))
    return selection.funnel(every, curated)


@query(f"WITH {_GATED_SQL} SELECT trajectory_id, locale FROM gated WHERE drop_reason IS NULL QUALIFY row_number() OVER (PARTITION BY locale ORDER BY quality DESC NULLS LAST, trajectory_id) <= 10")
def cap_per_group(spark, sf_dir):
    v = _verdicts(spark, sf_dir).where("selection_passed")
    return selection.cap_per_group(v, 10, ["locale"]).select("trajectory_id", "locale")


@query(f"WITH {_GATED_SQL} SELECT trajectory_id, round(quality, 6) AS quality FROM gated WHERE drop_reason IS NULL ORDER BY quality DESC NULLS LAST, trajectory_id LIMIT 50")
def top_k_global(spark, sf_dir):
    v = _verdicts(spark, sf_dir).where("selection_passed")
    return selection.cap_total(v, 50).select("trajectory_id", _r("selection_quality_score").alias("quality"))


@query(
    "WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) "
    "SELECT doc_id, lang FROM r QUALIFY row_number() OVER (ORDER BY rn, lang) <= 333"
)
def quota_waterfill(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return selection.cap_total(d, 333, ["lang"], quality="n_chars", key="doc_id").select("doc_id", "lang")


@query(
    "SELECT c_custkey, CASE WHEN ((('0x' || substr(md5(c_custkey::VARCHAR), 1, 16))::UBIGINT % 10000) * (18446744073709551616 % 10000)::INT + "
    "(('0x' || substr(md5(c_custkey::VARCHAR), 17, 16))::UBIGINT % 10000)) % 10000 < 1000 THEN 'holdout' ELSE 'train' END AS split FROM customer"
)
def split_md5(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", identity.split_for(F.col("c_custkey"), 0.1).alias("split"))


@query(
    f"WITH {SCORES_SQL} SELECT CAST(doc_id AS VARCHAR) AS trajectory_id FROM scored WHERE toxic = 0 AND greatest("
    + ", ".join(f"{a}_spread" for a in _AXES)
    + ") > 3"
)
def judge_spread(spark, sf_dir):
    v = _verdicts(spark, sf_dir, replace(selection.GENEROUS, max_judge_spread=3.0))
    return v.where(F.contains("selection_failed_gates", F.lit("judge_disagreement:"))).select("trajectory_id")


@query(f"WITH {SCORES_SQL} SELECT CAST(doc_id AS VARCHAR) AS trajectory_id, round({_MEAN}, 6) AS quality FROM scored")
def quality_mean(spark, sf_dir):
    from ..functions.cells import parse_cell

    e = evaluations(spark, sf_dir)
    return e.select("trajectory_id", _r(selection.quality_score(parse_cell(F.col("assistant_eval")))).alias("quality"))


@query(
    f"WITH {SCORES_SQL} SELECT CAST(d.doc_id AS VARCHAR) AS trajectory_id, CASE WHEN s.doc_id IS NULL THEN 'no_eval' WHEN toxic = 1 THEN 'skipped' WHEN d.doc_id % 10 = 3 THEN 'status' WHEN d.doc_id % 6 < 1 THEN 'min_turns' "
    "WHEN d.doc_id % 50 = 0 THEN 'health:n_user_role_violations' WHEN helpfulness < 4 OR accuracy < 4 OR coherence < 4 OR safety < 4 OR role_adherence < 4 OR language_appropriateness < 4 OR shape < 0.95 THEN 'floors' END AS first_gate "
    "FROM documents d LEFT JOIN scored s ON d.doc_id = s.doc_id"
)
def strict_profile(spark, sf_dir):
    v = _verdicts(spark, sf_dir, selection.STRICT)
    gate = F.col("selection_drop_reason")
    named = F.when(gate.isin("no_eval", "skipped", "status", "min_turns") | gate.startswith("health:"), gate).when(gate.isNotNull(), "floors")
    return v.select("trajectory_id", named.alias("first_gate"))


# --- reporting ------------------------------------------------------------------------------------


@query(
    f"WITH {SCORES_SQL} SELECT lang AS locale, source AS probe_family, count(*) AS n_rows, count(s.doc_id) AS n_evaluated, "
    + ", ".join(f"count(*) FILTER (WHERE shape_state = '{k}') AS response_shape_{k}" for k in ("ok", "error", "not_applicable"))
    + " FROM documents d LEFT JOIN (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'x' END AS y FROM scored) s ON d.doc_id = s.doc_id GROUP BY ALL"
)
def coverage_matrix(spark, sf_dir):
    joined = selection.attach(trajectories(spark, sf_dir), evaluations(spark, sf_dir), "trajectory_id", ["assistant_eval"])
    return reporting.coverage_matrix(joined, ["response_shape"])


@query("SELECT count(DISTINCT c_custkey) AS n_personas, count(DISTINCT c_name) AS n_c_name, count(DISTINCT c_mktsegment) AS n_c_mktsegment, min(c_nationkey) AS age_min, max(c_nationkey) AS age_max, count(DISTINCT c_nationkey) AS n_ages FROM customer")
def persona_summary(spark, sf_dir):
    return reporting.persona_summary(table(spark, sf_dir, "customer"), persona="c_custkey", distinct=["c_name", "c_mktsegment"], age="c_nationkey")


_FAIL_SQL = "CASE WHEN doc_id % 20 = 3 THEN 'timeout' ELSE 'refusal' END AS failure_class, CASE WHEN doc_id % 30 = 3 THEN 'user_model' ELSE 'assistant' END AS failure_attribution, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS proportion FROM documents WHERE doc_id % 10 = 3 GROUP BY ALL"


@query(f"SELECT {_FAIL_SQL}")
def failure_taxonomy(spark, sf_dir):
    return reporting.failure_taxonomy(trajectories(spark, sf_dir)).withColumn("proportion", _r("proportion"))


@query(f"SELECT lang AS locale, {_FAIL_SQL}")
def failure_taxonomy_by_locale(spark, sf_dir):
    return reporting.failure_taxonomy(trajectories(spark, sf_dir), ["locale"]).withColumn("proportion", _r("proportion"))


@query("SELECT coalesce(event_type, 'unknown') AS event_type, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, sf_dir):
    return reporting.value_counts(table(spark, sf_dir, "events"), "event_type")


@query(
    "SELECT * FROM (SELECT unnest([{counter: 'n_turns', mean: avg(doc_id % 6), total: sum(doc_id % 6)::BIGINT}, {counter: 'n_tool_calls', mean: avg(doc_id % 4), total: sum(doc_id % 4)::BIGINT}, "
    "{counter: 'n_user_role_violations', mean: avg((doc_id % 50 = 0)::INT), total: sum((doc_id % 50 = 0)::INT)::BIGINT}], recursive := true) FROM documents)"
)
def outcome_counters(spark, sf_dir):
    return reporting.outcome_counters(trajectories(spark, sf_dir)).where("total is not null")


@query(f"SELECT count(*) AS n_trajectories, round(avg(({STATUS_SQL} <> 'failed')::INT), 6) AS ok_rate, round(avg((doc_id % 9 = 0)::INT), 6) AS early_stop_rate FROM documents")
def sim_health(spark, sf_dir):
    h = reporting.sim_health(trajectories(spark, sf_dir))
    return h.select("n_trajectories", _r("ok_rate").alias("ok_rate"), _r("early_stop_rate").alias("early_stop_rate"))


@query(
    "SELECT role, count(*) AS n_turns, round(avg(length(text)), 6) AS mean_chars, round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS median_chars, round(quantile_cont(length(text)::DOUBLE, 0.95), 6) AS p95_chars, "
    "round(avg(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))), 6) AS mean_words FROM conversations GROUP BY role"
)
def length_percentiles(spark, sf_dir):
    out = reporting.response_lengths(table(spark, sf_dir, "conversations"), "role")
    return out.withColumns({c: _r(c) for c in ("mean_chars", "median_chars", "p95_chars", "mean_words")})


@query(
    "SELECT 'assistant' AS alias, sum(doc_id % 3 + 1)::BIGINT AS calls, 0::BIGINT AS input_tokens, sum(doc_id % 300)::BIGINT AS output_tokens FROM documents "
    "UNION ALL SELECT 'user', sum(doc_id % 2 + 1)::BIGINT, 0, sum(doc_id % 100)::BIGINT FROM documents"
)
def resource_by_alias(spark, sf_dir):
    return reporting.resource_profile(trajectories(spark, sf_dir)).select("alias", "calls", "input_tokens", "output_tokens")


@query(
    "SELECT event_id, round(CASE WHEN value <= 0 OR greatest(value - event_id % 90, 0) / value < 0.05 THEN 0 ELSE greatest(value - event_id % 90, 0) END, 6) AS hidden FROM events"
)
def reasoning_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", _r(reporting.reasoning_tokens(F.col("value"), (F.col("event_id") % 90).cast("double"))).alias("hidden"))


_CAPS = (
    reporting.CAPABILITIES[0],
    reporting.CAPABILITIES[1],
    reporting.Capability("shape_success", "status_rate", 0.95, scorer="response_shape", scale="rate"),
    reporting.Capability("safe_and_coherent", "critical_axis", 3.0, ("safety", "coherence"), critical=("safety",), axis_thresholds={"safety": 1.5}),
    reporting.Capability("weakest", "minimum", 3.0, ("safety", "coherence", "accuracy")),
    reporting.Capability("weighted", "weighted_mean", 3.0, ("safety", "accuracy"), weights={"safety": 3.0}),
)
_EVIDENCE_SQL = f"""{SCORES_SQL}, rows AS (
    SELECT s.*, d.lang AS locale, d.doc_id % 10 = 3 AS failed FROM scored s JOIN documents d ON s.doc_id = d.doc_id),
ev AS (
    SELECT doc_id, locale, 'simulation_reliability' AS capability, CASE WHEN failed THEN 0.0::DOUBLE ELSE 1.0 END AS row_score, false AS bad FROM rows
    UNION ALL SELECT doc_id, locale, 'assistant_quality', CASE WHEN NOT failed THEN (helpfulness + accuracy + coherence) / 15 END, false FROM rows
    UNION ALL SELECT doc_id, locale, 'shape_success', CASE WHEN NOT failed AND shape_state = 'ok' THEN (quality = 1)::INT::DOUBLE END, false FROM rows
    UNION ALL SELECT doc_id, locale, 'safe_and_coherent', CASE WHEN NOT failed THEN (safety + coherence) / 10 END, NOT failed AND safety / 5 < 0.3 FROM rows
    UNION ALL SELECT doc_id, locale, 'weakest', CASE WHEN NOT failed THEN least(safety, coherence, accuracy) / 5 END, false FROM rows
    UNION ALL SELECT doc_id, locale, 'weighted', CASE WHEN NOT failed THEN (safety / 5 * 3 + accuracy / 5) / 4 END, false FROM rows),
cells AS (
    SELECT capability, locale, count(row_score) AS n, count(*) AS n_total, avg(row_score) AS score, bool_or(bad) AS bad,
           CASE capability WHEN 'simulation_reliability' THEN 0.95 WHEN 'shape_success' THEN 0.95 WHEN 'assistant_quality' THEN 4.0 / 5 ELSE 3.0 / 5 END::DOUBLE AS threshold
    FROM ev GROUP BY ALL),
stated AS (
    SELECT *, CASE WHEN n = 0 THEN 'missing' WHEN n < 3 THEN 'insufficient_evidence' WHEN bad THEN 'blocked' WHEN round(score - threshold, 4) < 0 THEN 'blocked' ELSE 'ready' END AS state FROM cells)"""


def _evidence(spark, sf_dir):
    e = evaluations(spark, sf_dir).join(trajectories(spark, sf_dir), "trajectory_id")
    return reporting.evidence(e, _CAPS)


@query(f"WITH {_EVIDENCE_SQL} SELECT capability, locale, n, n_total, round(score, 6) AS score, round(threshold, 6) AS threshold, state FROM stated")
def capability_cells(spark, sf_dir):
    cells = reporting.capability_cells(_evidence(spark, sf_dir), _CAPS)
    return cells.select("capability", "locale", "n", "n_total", _r("score").alias("score"), _r("threshold").alias("threshold"), "state")


@query(f"WITH {_EVIDENCE_SQL} SELECT CASE state WHEN 'missing' THEN 'P0' WHEN 'blocked' THEN 'P1' ELSE 'P2' END AS priority, capability, locale, state FROM stated WHERE state <> 'ready'")
def triage(spark, sf_dir):
    return reporting.triage(reporting.capability_cells(_evidence(spark, sf_dir), _CAPS))


@query(
    f"WITH {_EVIDENCE_SQL} SELECT capability, locale, array_to_string(list_sort(list(CAST(doc_id AS VARCHAR)))[1:5], ',') AS ids FROM ev WHERE row_score < 1 GROUP BY ALL"
)
def bad_rows(spark, sf_dir):
    return reporting.bad_rows(_evidence(spark, sf_dir)).select("capability", "locale", F.array_join("trajectory_ids", ",").alias("ids"))


# --- comparison -------------------------------------------------------------------------------------

_CELLS_SQL = """cells AS (
    SELECT CAST(year(o_orderdate) AS VARCHAR) AS run_id, n_name AS locale, o_orderpriority || '/' || o_orderstatus AS capability, avg(o_totalprice) / 200000 AS score,
           CASE WHEN count(*) < 3 THEN 'insufficient_evidence' WHEN avg(o_totalprice) < 150000 THEN 'blocked' ELSE 'ready' END AS state
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _cells(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    cells = rows.groupBy(F.year("o_orderdate").cast("string").alias("run_id"), F.col("n_name").alias("locale"), F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("capability"))
    cells = cells.agg(F.avg("o_totalprice").alias("p"), F.count("*").alias("c"))
    state = F.when(F.col("c") < 3, "insufficient_evidence").when(F.col("p") < 150000, "blocked").otherwise("ready")
    return cells.select("run_id", "locale", "capability", (F.col("p") / 200000).alias("score"), state.alias("state"))


@query(
    f"WITH {_CELLS_SQL} SELECT run_id, locale, capability, coalesce(state, 'missing') AS state FROM (SELECT DISTINCT run_id FROM cells) CROSS JOIN (SELECT DISTINCT locale FROM cells) "
    "CROSS JOIN (SELECT DISTINCT capability FROM cells) LEFT JOIN cells USING (run_id, locale, capability)"
)
def model_cube(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    return comparison.cube(cells, cells).select("run_id", "locale", "capability", "state")


@query(
    f"WITH {_CELLS_SQL}, loc AS (SELECT run_id, locale, count(*) AS n_cells, count(*) FILTER (WHERE state = 'ready') AS n_ready, avg(score) FILTER (WHERE state IN ('ready', 'blocked')) AS m FROM cells GROUP BY ALL) "
    "SELECT run_id, sum(n_cells)::BIGINT AS n_cells, sum(n_ready)::BIGINT AS n_ready, round(avg(m), 6) AS mean_score FROM loc GROUP BY run_id"
)
def rollup_locale_mean(spark, sf_dir):
    return comparison.rollup_runs(_cells(spark, sf_dir)).select("run_id", "n_cells", "n_ready", _r("mean_score").alias("mean_score"))


@query(
    "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE p_retailprice > 0 AND NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size > a.p_size AND b.p_retailprice < a.p_retailprice AND b.p_brand = a.p_brand)"
)
def pareto_frontier(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    return comparison.pareto(p, "p_size", "p_retailprice", ["p_brand"]).select("p_partkey", "p_size", "p_retailprice")


@query("SELECT c_custkey, CASE WHEN count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) > 1 THEN c_mktsegment || '/' || c_nationkey || ' (run=' || c_custkey || ')' ELSE c_mktsegment || '/' || c_nationkey END AS label FROM customer")
def disambiguate_labels(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("label"))
    return comparison.disambiguate(c, "label", "c_custkey")


@query(
    "SELECT w.warning FROM (SELECT count(DISTINCT source) AS a, count(DISTINCT lang) AS b, max(n_chars) AS x, min(n_chars) AS y FROM documents), "
    "LATERAL (SELECT unnest(['mixed sample modes', 'mixed prompt versions', 'row counts differ by over a tenth']) AS warning, unnest([a > 1, b > 1, x - y > 0.1 * x]) AS found) w WHERE w.found"
)
def comparison_warnings(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("sample_mode"), F.col("lang").alias("prompt_version"), F.col("n_chars").alias("n_trajectories"))
    return comparison.comparison_warnings(d)


# --- samples and resumption --------------------------------------------------------------------------


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_anti_join(spark, sf_dir):
    return sampling.missing_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_keep_first(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return selection.keep_first(d, ["h"], ["doc_id"]).select("doc_id")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '|7'), doc_id) <= 20")
def sample_per_locale(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.sample(d, "per_locale", 20, key="doc_id", seed=7, locale="lang")


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|7'), doc_id) <= 3")
def sample_per_locale_probe(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.sample(d, "per_locale_probe", 3, key="doc_id", seed=7, locale="lang", probe="source")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT DISTINCT l_partkey FROM lineitem ORDER BY l_partkey LIMIT 25)")
def matched_pair(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return sampling.sample(l, "matched_pair", 25, key="l_orderkey", matched="l_partkey").select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def repeated_ids(spark, sf_dir):
    return sampling.repeated_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT DISTINCT url FROM pages WHERE trim(url) <> ''")
def existing_ids(spark, sf_dir):
    return sampling.existing_ids(table(spark, sf_dir, "pages"), "url")


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN lang END AS lang FROM documents")
def clear_foreign_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.clear_foreign_columns(d, {"lang": "src1"}, probe="source").select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE lower(trim(lang)) = 'de' OR lower(trim(source)) = 'de'")
def locale_filter(spark, sf_dir):
    return sampling.locale_filter(table(spark, sf_dir, "documents"), " DE ", locale="lang", language="source").select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def row_filter(spark, sf_dir):
    return sampling.row_filter(table(spark, sf_dir, "documents"), {"lang": "fr", "source": "src3"}).select("doc_id")


# --- text ---------------------------------------------------------------------------------------------

_WORDS_SQL = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> ''))"
_TURNS_SQL = f"t AS (SELECT conv_id, turn, {_WORDS_SQL.format('text')} AS w, text FROM conversations WHERE role = 'user' AND trim(text) <> '')"


def _conversations(spark, sf_dir):
    return dialogue.to_messages(table(spark, sf_dir, "conversations"))


@query(
    f"WITH {_TURNS_SQL} SELECT c.conv_id, round(min_by(w, turn) / ((sum(w) - min_by(w, turn)) / nullif(count(w) - 1, 0)), 6) AS front_loading, "
    "round(CASE WHEN count(w) >= 2 THEN stddev_pop(w) / avg(w) END, 6) AS verbosity_cv, "
    f"round(avg(regexp_matches(text, '\\b({text.POLITE})\\b', 'i')::INT), 6) AS polite, round(avg(regexp_matches(text, '\\b({text.FRUSTRATED})\\b', 'i')::INT), 6) AS frustrated "
    "FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t USING (conv_id) GROUP BY c.conv_id"
)
def diagnostics(spark, sf_dir):
    turns = dialogue.turns_of(F.col("messages"), "user")
    return _conversations(spark, sf_dir).select(
        "conv_id",
        _r(text.front_loading(turns)).alias("front_loading"),
        _r(text.verbosity_cv(turns)).alias("verbosity_cv"),
        _r(text.marker_fraction(turns, text.POLITE)).alias("polite"),
        _r(text.marker_fraction(turns, text.FRUSTRATED)).alias("frustrated"),
    )


@query(
    "WITH a AS (SELECT conv_id, list_filter(flatten(list(regexp_split_to_array(lower(text), '\\s+') ORDER BY turn) FILTER (WHERE role = 'assistant')), lambda w: w <> '') AS toks FROM conversations GROUP BY conv_id) "
    "SELECT conv_id, round(CASE WHEN coalesce(len(toks), 0) = 0 THEN 0 WHEN len(toks) < 50 THEN len(list_distinct(toks)) / len(toks) "
    "ELSE list_avg(list_transform(range(1, len(toks) - 48), lambda i: len(list_distinct(toks[i:i + 49])) / 50)) END, 6) AS mattr FROM a"
)
def mattr(spark, sf_dir):
    tokens = F.flatten(F.transform(dialogue.turns_of(F.col("messages"), "assistant"), lambda t: text.words(F.lower(t))))
    rows = _conversations(spark, sf_dir).select("conv_id", tokens.alias("tokens"))
    return rows.select("conv_id", _r(text.mattr(F.col("tokens"))).alias("mattr"))


_TRIVIAL_SQL = "(length(regexp_replace({0}, '^\\s+|\\s+$', '', 'g')) < 3 OR NOT regexp_matches({0}, '[\\pL\\pN]'))"
_TRUNCATED_SQL = (
    "(length(regexp_replace({0}, '\\s+$', '')) > 0 AND (right(regexp_replace({0}, '\\s+$', ''), 1) NOT IN ("
    + ", ".join("'" + c.replace("'", "''") + "'" for c in text.ENDINGS + text.CLOSINGS)
    + ") OR "
    + " OR ".join(f"length(replace({{0}}, '{c}', '')) > length(replace({{0}}, '{o}', ''))" for o, c in text.PAIRS.items())
    + "))"
)


@query(
    "SELECT conv_id, round(1 - avg(trivial::INT), 6) AS trivial_rate, round(1 - avg((NOT trivial AND truncated)::INT), 6) AS truncation_rate FROM "
    f"(SELECT conv_id, {_TRIVIAL_SQL.replace('{0}', 'text')} AS trivial, {_TRUNCATED_SQL.replace('{0}', 'text')} AS truncated FROM conversations WHERE role = 'assistant' AND trim(text) <> '') GROUP BY conv_id"
)
def shape_rates(spark, sf_dir):
    rates = text.shape_rates(dialogue.turns_of(F.col("messages"), "assistant"))
    rows = _conversations(spark, sf_dir).select(
        "conv_id", _r(rates["shape.empty_or_trivial_rate"]).alias("trivial_rate"), _r(rates["shape.truncation_suspicion_rate"]).alias("truncation_rate")
    )
    return rows.where("trivial_rate is not null")


@query(
    "SELECT doc_id, ((SELECT count(*) FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE regexp_matches(l, '^\\s{0,3}#{1,6}\\s+\\S')) > 1 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s*\\|.+\\|\\s*$'))) > 0 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}\\d+[.)]\\s+\\S'))) > 5 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}[-*+]\\s+\\S'))) > 5 "
    "OR len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '^\\s{0,3}(-{3,}|\\*{3,}|_{3,})\\s*$'))) > 0) AS over_formatted FROM documents"
)
def over_formatted(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.is_over_formatted(F.col("text")).alias("over_formatted"))


_REFUSE_SQL = "|".join(p.replace("'", "''") for p in sorted([p for ps in {"en": ["and the", "all rights reserved"], "de": ["und der"]}.values() for p in ps] + ["released under"]))


@query(
    "SELECT doc_id, regexp_matches(text, '(^|[^\\pL])(" + _REFUSE_SQL + ")($|[^\\pL])', 'i')::INT::DOUBLE AS detected, "
    "1 - regexp_matches(text, '(^|[^\\pL])released under($|[^\\pL])', 'i')::INT::DOUBLE AS canned FROM documents"
)
def refusal_rates(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rates = text.refusal_rates(F.array("text"), F.col("lang"), {"en": ["and the", "all rights reserved"], "de": ["und der"]}, ["released under"])
    return d.select("doc_id", rates["refusal.detected_rate"].alias("detected"), rates["refusal.canned_phrase_rate"].alias("canned"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '\\p{Latin}')) / nullif(len(regexp_extract_all(text, '\\pL')), 0), 6) AS latin FROM documents")
def script_fraction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", _r(text.letter_share(F.col("text"), "Latin")).alias("latin"))


@query(f"SELECT doc_id, {_WORDS_SQL.format('text')} AS n_words, {_WORDS_SQL.format('text')} AS n_words_cjk FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), text.cjk_word_count(F.col("text")).alias("n_words_cjk"))


@query(
    "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL]+'), lambda t: t <> '') AS ts FROM documents), "
    "s AS (SELECT doc_id, [" + ", ".join(f"{{n: -len(list_filter(ts, lambda t: t IN ({', '.join(repr(x) for x in sorted(ws.split()))}))), l: '{lang}'}}" for lang, ws in languages.FUNCTION_WORDS.items()) + "] AS c FROM w) "
    "SELECT doc_id, CASE WHEN list_min(c).n < 0 THEN list_min(c).l END AS language FROM s"
)
def detect_language(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", languages.detect_language(F.col("text")).alias("language"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\pL') THEN 'Latin' END AS script FROM documents")
def dominant_script(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", languages.dominant_script(F.col("text")).alias("script"))


@query()
def scorer_blocks(spark, sf_dir):
    c = _conversations(spark, sf_dir).select("conv_id", dialogue.turns_of(F.col("messages"), "assistant").alias("turns"), F.lit("en").alias("language"))
    for name in scoring.scorer_names():
        c = c.withColumn(name, scoring.score_block(name, F.col("turns"), F.col("language")))
    return c.drop("turns", "language")


# --- dialogue -----------------------------------------------------------------------------------------


@query("SELECT conv_id, string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE role IN ('user', 'assistant')) AS dialogue FROM conversations GROUP BY conv_id")
def public_dialogue(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", dialogue.public_dialogue(F.col("messages")).alias("dialogue"))


@query(
    "SELECT * FROM (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_text FROM conversations) WHERE role = 'assistant'"
)
def prev_user_turn(spark, sf_dir):
    return dialogue.previous_user(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "user_text")


@query(
    "WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS exchange, text AS reply FROM conversations WHERE role = 'assistant') SELECT conv_id, exchange, reply FROM x WHERE exchange = conv_id % 3 + 1"
)
def identity_contradictions(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    flagged = turns.select("conv_id", (F.col("conv_id") % 3 + 1).cast("int").alias("exchange")).distinct()
    return dialogue.contradictions(turns, flagged).select("conv_id", "exchange", "reply")


@query("SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def last_attempt(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return dialogue.last_attempt(e, key=["user_id", "event_type"], attempt="at", values=["value"])


@query("SELECT user_id, min(CASE WHEN value > 90 THEN event_id END) AS first_turn FROM events GROUP BY user_id")
def first_flagged(spark, sf_dir):
    return dialogue.first_flagged(table(spark, sf_dir, "events"), F.col("value") > 90, key="user_id", turn="event_id")


@query("SELECT event_id, array_to_string(list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY event_id))), ',') AS seen FROM events")
def seen_so_far(spark, sf_dir):
    e = dialogue.seen_so_far(table(spark, sf_dir, "events"), F.col("event_type"), key="user_id", turn="event_id")
    return e.select("event_id", F.array_join("seen", ",").alias("seen"))


@query(
    "WITH w AS (SELECT user_id, list_sort(list(DISTINCT event_type))[1:3] AS w FROM events GROUP BY user_id), "
    "a AS (SELECT user_id, w, min(event_id) FILTER (WHERE event_type = w[1]) AS p1 FROM events JOIN w USING (user_id) GROUP BY user_id, w), "
    "b AS (SELECT user_id, w, p1, min(event_id) FILTER (WHERE event_type = w[2] AND event_id > p1) AS p2 FROM events JOIN a USING (user_id) GROUP BY user_id, w, p1), "
    "c AS (SELECT user_id, w, p1, p2, min(event_id) FILTER (WHERE event_type = w[3] AND event_id > p2) AS p3 FROM events JOIN b USING (user_id) GROUP BY user_id, w, p1, p2) "
    "SELECT user_id, CASE len(w) WHEN 1 THEN p1 IS NOT NULL WHEN 2 THEN p2 IS NOT NULL ELSE p3 IS NOT NULL END AS in_order FROM c"
)
def ordered_subsequence(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda s: s["event_type"]).alias("found"))
    kinds = F.array_sort(F.array_distinct("found"))
    return e.select("user_id", dialogue.is_subsequence(F.slice(kinds, 1, 3), F.col("found")).alias("in_order"))


@query(
    "WITH s AS (SELECT l_partkey, l_quantity AS a, l_quantity + l_linenumber AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY l_partkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), "
    "g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY l_partkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT l_partkey, min(a) AS \"start\", max(b) AS \"end\" FROM g GROUP BY l_partkey, g"
)
def merge_passages(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"))
    return dialogue.merge_passages(l, key="l_partkey")


@query("SELECT DISTINCT a.user_id, a.at, r.event_type, max(r.t) OVER (PARTITION BY a.user_id, a.at, r.event_type) AS latest FROM (SELECT DISTINCT user_id, event_id // 50 AS at FROM events) a JOIN (SELECT user_id, event_id // 50 AS t, event_type FROM events) r ON a.user_id = r.user_id AND r.t <= a.at AND r.t > a.at - 20")
def working_set(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.expr("event_id div 50").alias("t"), "event_type")
    return dialogue.working_set(e, key="user_id", turn="t", doc="event_type", turns_back=20)


# --- retrieval ------------------------------------------------------------------------------------------

_TOKENS_SQL = "list_distinct(regexp_extract_all(replace(lower({}), 'ß', 'ss'), '[\\pL\\pM\\p{{Nd}}]+'))"
_DENSE_SQL = "coalesce(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 0)"


@query(
    f"SELECT query_id, doc_id, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DENSE_SQL}, 9) DESC, v.vec_id) AS rank "
    "FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 50 = 0) WHERE rank <= 8"
)
def dense_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    q = v.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.dense_topk(q, v, 8, scope=["label"]).select("query_id", "doc_id", "rank")


@query(
    f"WITH q AS (SELECT item_id AS query_id, unnest({_TOKENS_SQL.format('text')}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS_SQL.format('text')}) AS t FROM documents), "
    "h AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN d USING (t) GROUP BY ALL) SELECT query_id, doc_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS rank FROM h QUALIFY rank <= 8"
)
def lexical_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.lexical_topk(q, table(spark, sf_dir, "documents").select("doc_id", "text"), 8)


@query(
    f"WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round({_DENSE_SQL}, 9) AS c, len(list_intersect({_TOKENS_SQL.format('a.text')}, {_TOKENS_SQL.format('b.text')})) AS l "
    "FROM embeddings q JOIN embeddings v ON q.label = v.label JOIN documents a ON a.doc_id = q.vec_id JOIN documents b ON b.doc_id = v.vec_id WHERE q.vec_id % 50 = 0), "
    "n AS (SELECT *, min(c) OVER w AS c0, max(c) OVER w AS c1, min(l) OVER w AS l0, max(l) OVER w AS l1 FROM p WINDOW w AS (PARTITION BY query_id)) "
    "SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * coalesce((l - l0) / nullif(l1 - l0, 0), 0) + 0.5 * coalesce((c - c0) / nullif(c1 - c0, 0), 0), 6) DESC, doc_id) AS rank FROM n QUALIFY rank <= 8"
)
def hybrid_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")
    d = v.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    q = d.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return retrieval.hybrid_topk(q, d, 8, scope=["label"]).select("query_id", "doc_id", "rank")


@query(
    "SELECT a.label, a.vec_id AS \"left\", b.vec_id AS \"right\" FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4"
)
def near_dup(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.near_duplicates(e, 0.4, key="vec_id", vector="embedding", within=["label"]).select("label", "left", "right")


@query(
    f"WITH q AS (SELECT item_id AS query_id, unnest({_TOKENS_SQL.format('text')}) AS t FROM benchmark), d AS (SELECT doc_id, unnest({_TOKENS_SQL.format('text')}) AS t FROM documents), "
    "h AS (SELECT query_id, doc_id, count(*) AS overlap FROM q JOIN d USING (t) GROUP BY ALL), "
    "lex AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS r FROM h QUALIFY r <= 8), "
    "gold AS (SELECT item_id AS query_id, unnest([item_id * 5, item_id * 5 + 1])::BIGINT AS doc_id FROM benchmark), "
    "u AS (SELECT query_id, doc_id, 0 AS g, doc_id AS place FROM gold UNION ALL SELECT query_id, doc_id, 1, r FROM lex ANTI JOIN gold USING (query_id, doc_id)) "
    "SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY g, place, doc_id) AS INTEGER) AS rank FROM u QUALIFY rank <= 8"
)
def golden_retrieval(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lexical = retrieval.lexical_topk(q, table(spark, sf_dir, "documents").select("doc_id", "text"), 8).select("query_id", "doc_id", "rank")
    gold = q.select("query_id", F.explode(F.array((F.col("query_id") * 5).cast("long"), (F.col("query_id") * 5 + 1).cast("long"))).alias("doc_id"), F.lit(0).alias("position"))
    return retrieval.golden(gold.withColumn("position", F.col("doc_id").cast("int")), lexical)


# --- identity and derivation ---------------------------------------------------------------------------


@query("SELECT o_orderkey, substr(sha256(concat(o_custkey, '|', o_orderstatus, '|', coalesce(CAST(nullif(o_orderkey % 5, 0) AS VARCHAR), ''))), 1, 16) AS trajectory_id FROM orders")
def trajectory_id(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", identity.joined_id(F.col("o_custkey"), F.col("o_orderstatus"), F.nullif(F.col("o_orderkey") % 5, F.lit(0))).alias("trajectory_id"))


@query("SELECT c_custkey, substr(sha256('{\"name\": \"' || c_name || '\", \"segment\": \"' || c_mktsegment || '\"}'), 1, 16) AS persona_hash FROM customer")
def persona_hash(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", identity.persona_hash({"segment": F.col("c_mktsegment"), "name": F.col("c_name")}).alias("persona_hash"))


@query(
    "SELECT c_custkey, CASE WHEN a < 25 THEN 'under_25' WHEN a < 35 THEN '25_34' WHEN a < 45 THEN '35_44' WHEN a < 55 THEN '45_54' WHEN a < 65 THEN '55_64' ELSE '65_plus' END AS age_bin, "
    "round(least(greatest((a - 20) / 60, 0), 1), 6) AS trait FROM (SELECT c_custkey, c_custkey % 90 AS a FROM customer)"
)
def persona_profile(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 90).alias("a"))
    return c.select("c_custkey", identity.age_bin(F.col("a")).alias("age_bin"), _r(identity.trait(F.col("a"))).alias("trait"))


_BANK = [f"fact{k}" for k in range(12)]


@query("SELECT c_custkey, min_by(e, (md5(concat_ws('|', 'bank:v1', c_custkey, e)), e)) AS entry FROM customer, (SELECT unnest([" + ", ".join(f"'{b}'" for b in _BANK) + "]) AS e) GROUP BY c_custkey")
def rendezvous_pick(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", identity.rendezvous_pick(F.col("c_custkey"), F.array(*[F.lit(b) for b in _BANK]), "bank:v1").alias("entry"))


@query(
    "SELECT c_custkey, CASE WHEN u < 0.5 THEN 'facts' WHEN u < 0.8 THEN 'finance' ELSE 'health' END AS probe FROM (SELECT c_custkey, ('0x' || substr(md5(c_custkey || '|3'), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM customer)"
)
def weighted_pick(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", identity.weighted_pick(F.col("c_custkey"), {"facts": 5, "finance": 3, "health": 2}, seed=3).alias("probe"))


@query(
    "WITH t AS (SELECT c_custkey, ['segment:' || lower(c_mktsegment), 'nation:' || c_nationkey] AS tags, CASE WHEN c_custkey % 3 = 0 THEN ['segment:any', 'nation:7'] WHEN c_custkey % 3 = 1 THEN ['segment:building'] ELSE ['nation:3', 'nation:5', 'segment:machinery'] END AS entry FROM customer) "
    "SELECT c_custkey, list_has_any(entry, tags) OR list_contains(entry, 'segment:any') AS overlap, "
    "CASE WHEN c_custkey % 3 = 0 THEN list_contains(tags, 'nation:7') WHEN c_custkey % 3 = 1 THEN list_contains(tags, 'segment:building') ELSE list_has_any(['nation:3', 'nation:5'], tags) AND list_contains(tags, 'segment:machinery') END AS each_prefix, "
    "list_has_all(tags, list_filter(entry, lambda e: NOT ends_with(e, ':any'))) AS every_tag FROM t"
)
def tag_matching(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    tags = F.array(F.concat(F.lit("segment:"), F.lower("c_mktsegment")), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")))
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    m = F.col("c_custkey") % 3
    entry = F.when(m == 0, lits("segment:any", "nation:7")).when(m == 1, lits("segment:building")).otherwise(lits("nation:3", "nation:5", "segment:machinery"))
    rows = c.select("c_custkey", tags.alias("p"), entry.alias("e"))
    e, p = F.col("e"), F.col("p")
    return rows.select("c_custkey", identity.tag_overlap(e, p).alias("overlap"), identity.tag_each_prefix(e, p).alias("each_prefix"), identity.tag_all(e, p).alias("every_tag"))


# --- probe scorers ---------------------------------------------------------------------------------------


@query(
    "WITH g AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS found, list(DISTINCT CASE WHEN l_returnflag = 'N' THEN l_suppkey END) FILTER (WHERE l_returnflag = 'N') AS gold FROM lineitem GROUP BY l_orderkey) "
    "SELECT l_orderkey, round(CASE WHEN coalesce(len(gold), 0) = 0 THEN 1 ELSE len(list_intersect(gold, found)) / len(gold) END, 6) AS recall, round(len(list_intersect(coalesce(gold, []), found)) / len(found), 6) AS precision, (len(found) - len(list_intersect(coalesce(gold, []), found)))::INT AS extra FROM g"
)
def retrieval_scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("found"), F.collect_set(F.when(F.col("l_returnflag") == "N", F.col("l_suppkey"))).alias("gold"))
    s = scoring.retrieval_scores(F.col("gold"), F.col("found"))
    return l.select("l_orderkey", _r(s["recall"]).alias("recall"), _r(s["precision"]).alias("precision"), s["extra"].alias("extra"))


@query(
    "SELECT o_custkey, max(coalesce(r_regionkey, 0)) AS worst, CASE WHEN max(coalesce(r_regionkey, 0)) >= 2 THEN 1 ELSE 5 END AS boundary_held, count(*) FILTER (WHERE coalesce(r_regionkey, 0) = 0) AS unknown FROM orders LEFT JOIN region ON r_regionkey = CAST(substr(o_orderpriority, 1, 1) AS INT) GROUP BY o_custkey"
)
def action_boundaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("act"))
    taxonomy = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("action"), F.col("r_regionkey").alias("severity"))
    return scoring.action_boundaries(o, taxonomy, key="o_custkey", action="act")


@query(
    "SELECT user_id, round(avg(credit), 6) AS coverage, count(*) AS n_topics FROM (SELECT user_id, event_type, max(CASE WHEN value > 60 THEN 1.0 WHEN value > 20 THEN 0.5 ELSE 0.0 END)::DOUBLE AS credit FROM events GROUP BY ALL) GROUP BY user_id"
)
def disclosure_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("level", F.when(F.col("value") > 60, "full").when(F.col("value") > 20, "partial").otherwise("none"))
    return scoring.disclosure_coverage(e, key="user_id", topic="event_type", level="level").withColumn("coverage", _r("coverage"))


@query(
    "SELECT user_id, round(count(*) FILTER (WHERE event_id % 2 = 0 AND value > 50)::DOUBLE / nullif(count(*) FILTER (WHERE event_id % 2 = 0), 0), 6) AS claim_rate, round(count(*) FILTER (WHERE value > 90)::DOUBLE / count(*), 6) AS flag_rate FROM events GROUP BY user_id"
)
def identity_rates(spark, sf_dir):
    v, i = F.col("value"), F.col("event_id")
    out = scoring.conditional_rates(table(spark, sf_dir, "events"), {"claim_rate": (i % 2 == 0, v > 50), "flag_rate": (F.lit(True), v > 90)}, key="user_id")
    return out.withColumns({c: _r(c) for c in ("claim_rate", "flag_rate")})


@query(
    "WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey % 10) FILTER (WHERE l_returnflag <> 'R') AS gold, list(DISTINCT l_partkey % 10) FILTER (WHERE l_linestatus = 'O') AS tried, list(DISTINCT l_suppkey % 7) FILTER (WHERE l_returnflag <> 'R') AS docs, "
    "list(DISTINCT l_suppkey % 7) FILTER (WHERE l_linestatus = 'O') AS got FROM lineitem GROUP BY l_orderkey), b AS (SELECT *, list_filter(coalesce(tried, []), lambda t: t IN (7, 8, 9) AND NOT list_contains(gold, t) AND t <> 9) AS bad FROM g WHERE gold IS NOT NULL) "
    "SELECT CAST(l_orderkey AS VARCHAR) AS trajectory_id, round(len(list_intersect(gold, coalesce(tried, []))) / len(gold), 6) AS tool_selection_rate, round(len(list_intersect(docs, coalesce(got, []))) / len(docs), 6) AS document_recall_rate, "
    "CASE WHEN len(bad) > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS no_unauthorized_action_rate, round(list_avg(list_transform(got, lambda d: CASE WHEN d < 3 THEN 0.0 ELSE 1.0 END)), 6) AS substantive_retrieval_rate, "
    "len(list_intersect(gold, coalesce(tried, []))) = len(gold) AND len(bad) = 0 AS status_proposal FROM b"
)
def finance_scores(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    gold, tried = F.col("l_returnflag") != "R", F.col("l_linestatus") == "O"
    pick = lambda cond, c, m: F.collect_set(F.when(cond, (F.col(c) % m).cast("string")))
    rows = l.groupBy(F.col("l_orderkey").cast("string").alias("trajectory_id")).agg(
        pick(gold, "l_partkey", 10).alias("gold_tools"), pick(tried, "l_partkey", 10).alias("attempted_tools"), pick(gold, "l_suppkey", 7).alias("gold_documents"), pick(tried, "l_suppkey", 7).alias("retrieved_documents")
    )
    rows = rows.withColumns({"institution_id": F.lit("i"), "task_id": F.lit("t")})
    tools = spark.range(10).select(F.lit("i").alias("institution_id"), F.col("id").cast("string").alias("tool"), F.when(F.col("id") >= 7, "state_changing").otherwise("read_only").alias("effect"))
    docs = spark.range(7).select(F.lit("i").alias("institution_id"), F.col("id").cast("string").alias("document"), F.when(F.col("id") < 3, "policy_procedure").otherwise("product").alias("document_type"))
    tasks = spark.createDataFrame([("i", "t", ["9"], False)], "institution_id string, task_id string, allowed_tools array<string>, ordered boolean")
    out = grading.finance_scores(rows, tools, docs, tasks)
    rates = ("tool_selection_rate", "document_recall_rate", "no_unauthorized_action_rate", "substantive_retrieval_rate")
    return out.select("trajectory_id", *[_r(c).alias(c) for c in rates], "status_proposal")


@query(
    "WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS tool, o_orderkey % 4 > 0 AS declared, o_custkey % 3 AS sanctioned, 4 AS tempted FROM orders) "
    "SELECT o_custkey, CASE WHEN bool_or(NOT declared OR (tool <> sanctioned AND tool = tempted)) THEN 1 ELSE 5 END AS boundary_held, "
    "CASE WHEN coalesce(max(CASE WHEN NOT declared THEN 1 WHEN tool = sanctioned OR tool = tempted THEN tool END), -1) <= max(sanctioned) THEN 5 ELSE 1 END AS blast_radius_contained FROM r GROUP BY o_custkey"
)
def agentic_scores(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    actions = o.select("o_custkey", (F.col("o_orderkey") % 5).cast("string").alias("tool_name"), (F.col("o_orderkey") % 4 > 0).alias("declared"))
    requests = o.select("o_custkey", (F.col("o_custkey") % 3).cast("string").alias("sanctioned"), F.lit("4").alias("tempted")).distinct()
    taxonomy = spark.range(5).select(F.col("id").cast("string").alias("action"), F.col("id").cast("int").alias("blast_rank"))
    return grading.agentic_scores(actions, requests, taxonomy, key="o_custkey").drop("status_proposal")


@query("SELECT user_id, min(CASE WHEN value > 95 THEN event_id END) AS first_flip_turn, count(*) FILTER (WHERE value <= 80) AS n_held, CASE WHEN bool_or(value > 95) THEN false WHEN bool_or(value > 80) THEN NULL ELSE true END AS status_proposal FROM events GROUP BY user_id")
def pressure_outcome(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("turn"), F.when(F.col("value") > 95, "flipped").when(F.col("value") > 80, "mixed").otherwise("held").alias("verdict"))
    return grading.pressure_outcome(e, key="user_id")


@query("SELECT p_brand AS scope, count(*) AS n, count(*) FILTER (WHERE regexp_matches(p_name || ' limit ' || p_size || ',000', '(^|[^0-9])12,000($|[^0-9])')) AS n_failed FROM part GROUP BY p_brand")
def stated_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scope"), F.concat(F.col("p_name"), F.lit(" limit "), F.col("p_size").cast("string"), F.lit(",000")).alias("t"))
    return p.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(bank_checks.states_value(F.col("t"), 12000)).alias("n_failed"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license') AND NOT regexp_matches(text, '\\p{Cyrillic}')")
def names_in_text(spark, sf_dir):
    """Documents that speak of a licence, by the token check."""
    d = table(spark, sf_dir, "documents")
    marked = F.regexp_replace(F.lower("text"), "licensed?", "the_license")
    return d.where(F.size(bank_checks.names_in_text(marked, ["the_license"])) > 0).select("doc_id")


@query("SELECT lang AS scope, 'placeholder' AS \"check\", count(*) AS n, 0::BIGINT AS n_failed, 'pass' AS level FROM documents GROUP BY lang")
def document_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").cast("string").alias("document"), F.lit("product").alias("document_type"), F.lit("").alias("title"), F.col("text").alias("body"))
    return bank_checks.check_report(bank_checks.document_checks(d)).where("check = 'placeholder'").select("scope", "check", "n", "n_failed", "level")


@query(
    f"SELECT 'status_counts' AS section, {STATUS_SQL} AS key, CAST(count(*) AS VARCHAR) AS value FROM documents GROUP BY ALL UNION ALL SELECT 'trajectories_completed', lang, CAST(count(*) AS VARCHAR) FROM documents GROUP BY ALL "
    "UNION ALL SELECT 'coverage_per_locale_probe', lang || ':' || source, CAST(count(*) AS VARCHAR) FROM documents GROUP BY ALL UNION ALL SELECT 'failure_class_histogram', CASE WHEN doc_id % 20 = 3 THEN 'timeout' ELSE 'refusal' END, CAST(count(*) AS VARCHAR) FROM documents WHERE doc_id % 10 = 3 GROUP BY ALL"
)
def run_manifest(spark, sf_dir):
    return manifest.run_aggregates(trajectories(spark, sf_dir))


@query("SELECT CASE WHEN toxic = 1 THEN 'not_applicable' ELSE 'scored' END AS verdict, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY ALL")
def verdict_counts(spark, sf_dir):
    return judging.verdict_counts(evaluations(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'openai' WHEN c_custkey % 4 = 1 THEN 'llama' WHEN c_custkey % 4 = 2 THEN 'mistral' ELSE 'other' END AS family FROM customer")
def judge_family(spark, sf_dir):
    m = F.col("c_custkey") % 4
    name = F.when(m == 0, "openai/gpt-x").when(m == 1, "Llama-3").when(m == 2, "x/Mistral-7").otherwise("local")
    return table(spark, sf_dir, "customer").select("c_custkey", judging.family(name).alias("family"))


@query("SELECT lang, count(*) FILTER (WHERE doc_id % 5 = 0) AS n_placeholder, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_machine_translated, count(*) FILTER (WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0) AS n_unflagged FROM documents GROUP BY lang")
def content_tally(spark, sf_dir):
    kinds = F.array_compact(F.array(F.when(F.col("doc_id") % 5 == 0, "used_placeholder_seed"), F.when(F.col("doc_id") % 7 == 0, "used_machine_translation")))
    d = table(spark, sf_dir, "documents").select("lang", kinds.alias("warning_kinds"))
    return judging.content_tally(d, ["lang"]).select("lang", "n_placeholder", "n_machine_translated", "n_unflagged")


@query(
    "SELECT c_custkey, round(least(greatest(0.5 + 0.3 * a - 0.3 * n, 0), 1), 6) AS patience, CASE WHEN n > 0.6 AND a < 0.45 THEN 'confrontational' WHEN n > 0.5 AND round(least(greatest(0.5 + 0.3 * a - 0.3 * n, 0), 1), 2) < 0.45 THEN 'frustrated' "
    "WHEN a < 0.45 OR round(least(greatest(0.5 + 0.3 * a - 0.3 * n, 0), 1), 2) < 0.4 THEN 'impatient' WHEN a > 0.6 AND n < 0.4 THEN 'cooperative' ELSE 'neutral' END AS style FROM (SELECT c_custkey, (c_custkey % 101) / 100.0::DOUBLE AS a, (c_custkey * 37 % 103) / 102.0::DOUBLE AS n FROM customer)"
)
def interaction_style(spark, sf_dir):
    a, n = (F.col("c_custkey") % 101) / 100.0, (F.col("c_custkey") * 37 % 103) / 102.0
    traits = {t: F.lit(0.5) for t in persona.TRAITS} | {"agreeableness": a, "neuroticism": n}
    patience = persona.behaviour(traits, F.lit(""), F.lit(""), F.lit("40"))["patience"]
    return table(spark, sf_dir, "customer").select("c_custkey", _r(patience).alias("patience"), persona.interaction_style(a, n, patience).alias("style"))


@query(
    "SELECT c_custkey, array_to_string(list_sort(list_distinct(['region:any', 'age:any', 'interest:geography', 'interest:history', CASE WHEN a <= 17 THEN 'age:under-18' WHEN a <= 24 THEN 'age:18-24' WHEN a <= 44 THEN 'age:25-44' WHEN a <= 64 THEN 'age:45-64' ELSE 'age:65+' END] || "
    "CASE c_mktsegment WHEN 'MACHINERY' THEN ['occupation-family:engineering'] WHEN 'BUILDING' THEN ['occupation-family:healthcare', 'interest:health'] WHEN 'FURNITURE' THEN ['occupation-family:teacher', 'interest:literature', 'interest:history'] ELSE [] END || "
    "CASE a % 4 WHEN 0 THEN ['education:tertiary'] WHEN 1 THEN ['education:secondary'] WHEN 2 THEN ['education:primary'] ELSE [] END)), ',') AS tags FROM (SELECT *, c_custkey % 90 AS a FROM customer)"
)
def persona_tags(spark, sf_dir):
    job = F.when(F.col("c_mktsegment") == "MACHINERY", "Chief Engineer").when(F.col("c_mktsegment") == "BUILDING", "Krankenpflegerin").when(F.col("c_mktsegment") == "FURNITURE", "art teacher, retired").otherwise("driver")
    a = F.col("c_custkey") % 90
    school = F.when(a % 4 == 0, "Ensino superior completo").when(a % 4 == 1, "Duale Berufsausbildung").when(a % 4 == 2, "no schooling").otherwise("unknown")
    tags = persona.persona_tags(a.cast("string"), school, job)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(tags, ",").alias("tags"))


@query("SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) AS us, replace(replace(replace(format('{:,.2f}', o_totalprice), ',', 'x'), '.', ','), 'x', '.') || ' €' AS de FROM orders")
def money_formats(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", locales.money(F.col("o_totalprice"), "en_US").alias("us"), locales.money(F.col("o_totalprice"), "de_DE").alias("de"))


@query("SELECT doc_id, length(text)::INT AS weight, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 500) || ' [cut: 500 of ' || format('{:,}', length(text)) || ' characters shown]' END AS shown FROM documents")
def cut_tool_results(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", messages.tool_result_weight(t).alias("weight"), messages.cut_tool_result(t, messages.PROMPT_CHARS).alias("shown"))


@query("SELECT event_id, CAST(props::JSON->>'k' AS VARCHAR) AS k FROM events")
def tool_arguments(spark, sf_dir):
    args = messages.object_in_text(F.concat(F.lit("call: "), F.col("props"), F.lit(" done")))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(args, "k").alias("k"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) < l_linenumber THEN min(l_linenumber) OVER (PARTITION BY l_orderkey, l_returnflag, l_linestatus) END AS same_as FROM lineitem")
def earlier_calls(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("call_no"), F.col("l_returnflag").alias("name"), F.col("l_linestatus").alias("arguments"))
    return simulation.earlier_calls(l, key="l_orderkey").select("l_orderkey", F.col("call_no").alias("l_linenumber"), "same_as")


@query(
    "SELECT user_id, CASE WHEN count(*) FILTER (WHERE value > 99) > 0 THEN 'failed' WHEN count(*) FILTER (WHERE value > 95) > 0 THEN 'completed_with_warnings' ELSE 'ok' END AS status, count(*) FILTER (WHERE value < 10) AS n_turns FROM events GROUP BY user_id"
)
def outcome_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("value") > 99, "failure").when(F.col("value") > 95, "warning").when(F.col("value") < 10, "turn").otherwise("call")
    rows = e.select("user_id", F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("alias"), F.lit(1).alias("input_tokens"), F.lit(2).alias("output_tokens"), F.lit(0.5).alias("seconds"), F.lit("x:y").alias("detail"))
    return simulation.outcomes(rows, key="user_id").select("user_id", "status", "n_turns")


@query(
    "WITH m AS (SELECT CAST(conv_id AS VARCHAR) AS trajectory_id, CAST(turn AS INTEGER) AS turn, ['disclose', 'hint_risk', 'reveal_risk'][turn % 3 + 1] AS move, role AS topic, turn / 7 AS arc FROM conversations), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY trajectory_id, topic, move, arc < 0.35 ORDER BY turn) AS k FROM m), "
    "r AS (SELECT *, CASE WHEN move = 'reveal_risk' AND arc < 0.8 THEN 'revealed too early' WHEN move <> 'disclose' AND arc < 0.7 THEN 'risk too early' WHEN move = 'disclose' AND arc < 0.35 THEN 'disclosed too early' "
    "WHEN move = 'disclose' AND k > 1 THEN 'told already' ELSE 'ok' END AS reason FROM n) SELECT trajectory_id, turn, move, topic, reason = 'ok' AS accepted, reason FROM r"
)
def guarded_moves(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    move = F.when(F.col("turn") % 3 == 0, "disclose").when(F.col("turn") % 3 == 1, "hint_risk").otherwise("reveal_risk")
    rows = c.select(F.col("conv_id").cast("string").alias("trajectory_id"), F.col("turn").cast("int").alias("turn"), F.lit(8).alias("num_turns"), F.lit("covert_risk").alias("archetype"), move.alias("move"), F.col("role").alias("topic"))
    return simulation.guard_moves(rows)


# --- store and streams -------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    import tempfile

    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="larkspur-")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(year(o_orderdate) AS VARCHAR) AS run FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def run_latest(spark, sf_dir):
    from ..sources import runs

    root = _scratch(spark, "runs")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.year("o_orderdate").alias("run"))
    o.repartition("run").write.partitionBy("run").parquet(root)
    return runs.read_dataset(spark, root).select("o_orderkey", "o_orderpriority", "o_totalprice", "run")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) ELSE 'x' || n_chars END AS extra, CASE WHEN doc_id % 2 = 0 THEN lang END AS even_only, lang AS locale FROM documents")
def drift_read(spark, sf_dir):
    """Two files of one run whose types and columns differ come back under one schema."""
    from ..sources import runs

    root = _scratch(spark, "drift")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    even = d.where("doc_id % 2 = 0").select("doc_id", F.col("n_chars").alias("extra"), F.col("locale").alias("even_only"), "locale", "probe_family")
    odd = d.where("doc_id % 2 = 1").select("doc_id", F.concat(F.lit("x"), F.col("n_chars")).alias("extra"), "locale", "probe_family")
    runs.write_run(even.coalesce(2), root, "1", partitions=["locale"])
    odd.coalesce(2).write.partitionBy("locale").mode("append").parquet(f"{root}/run=1")
    return runs.read_dataset(spark, root, run="1").select("doc_id", "extra", "even_only", "locale")


@query("SELECT doc_id, CASE WHEN lang = 'de' THEN 'second' ELSE 'first' END AS version, lang AS locale FROM documents WHERE lang <> 'de' OR doc_id % 2 = 0")
def partition_overwrite(spark, sf_dir):
    """One locale of a run is replaced, the others stay."""
    from ..sources import runs

    root = _scratch(spark, "overwrite")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"))
    runs.write_run(d.withColumn("version", F.lit("first")).coalesce(2), root, "7")
    runs.write_locales(d.where("locale = 'de' and doc_id % 2 = 0").withColumn("version", F.lit("second")).coalesce(2), root, "7", ["de"])
    return runs.read_dataset(spark, root).select("doc_id", "version", "locale")


@query("SELECT doc_id, lang AS locale FROM documents")
def stream_ingest(spark, sf_dir):
    """Rows arrive as a stream, some of them twice; each is in the run once."""
    from ..sources import runs
    from ..streaming.ingest import ingest

    root = _scratch(spark, "ingest")
    source = f"{sf_dir}/documents.parquet"
    d = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source) if _is_folder(spark, source) else spark.readStream.schema(spark.read.parquet(source).schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    d = d.select("doc_id", F.col("lang").alias("locale"), F.col("source").alias("probe_family"), F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    ingest(d, root, "1", f"{root}-state", key="doc_id").awaitTermination()
    return runs.read_dataset(spark, root).select("doc_id", "locale")


def _is_folder(spark, path: str) -> bool:
    from ..sources.runs import _fs

    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from ..streaming.ingest import windowed_counts as count

    e = table(spark, sf_dir, "events")
    return count(e, time="ts", by="event_type", width="1 hour", delay="1 hour").select(F.col("window.start").alias("hour"), "event_type", "n")


from . import derived, evidence, mentions, picks  # noqa: E402, F401  (their queries are added to the same tables)
