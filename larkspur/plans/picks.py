"""Queries of seeded picks with fallback, document plans and gazetteer regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import persona
from ..operators import finance, judging, picks, populations
from .queries import query
from .views import table


@query(
    "WITH p AS (SELECT c_custkey AS k, c_nationkey % 11 AS place, c_nationkey % 6 AS domain, ['seg:' || lower(c_mktsegment)] || CASE WHEN c_custkey % 2 = 0 THEN ['even'] ELSE [] END AS tags FROM customer), "
    "t AS (SELECT p_partkey AS task_id, p_partkey % 23 AS place, p_partkey % 5 AS domain, CASE p_size % 5 WHEN 1 THEN ['seg:building'] WHEN 2 THEN ['even', 'seg:furniture'] WHEN 3 THEN ['even'] WHEN 4 THEN ['seg:machinery'] ELSE CASE WHEN p_partkey % 5 = 1 THEN ['nobody'] ELSE []::VARCHAR[] END END AS asked FROM part), "
    "lvl AS (SELECT k, task_id, asked, 0 AS level FROM p JOIN t ON p.place = t.place AND p.domain = t.domain WHERE list_has_all(tags, asked) "
    "UNION ALL SELECT k, task_id, asked, 1 FROM p JOIN t ON p.domain = t.domain WHERE list_has_all(tags, asked) UNION ALL SELECT k, task_id, [], 2 FROM p JOIN t ON p.domain = t.domain), "
    "best AS (SELECT * FROM lvl QUALIFY level = min(level) OVER (PARTITION BY k)), "
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY asked, task_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM best) "
    "SELECT p.k AS c_custkey, task_id, level FROM p LEFT JOIN (SELECT * FROM numbered WHERE i = floor(CAST('0x' || md5(k || '|pick|0')[1:12] AS BIGINT) / 281474976710656.0 * n)) b ON p.k = b.k"
)
def picked_tasks(spark, sf_dir):
    """A task of the customer's own place, else of its domain, else of the domain whatever it asks for."""
    c, part = table(spark, sf_dir, "customer"), table(spark, sf_dir, "part")
    tags = F.concat(F.array(F.concat(F.lit("seg:"), F.lower("c_mktsegment"))), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("even"))).otherwise(F.expr("array()").cast("array<string>")))
    people = c.select("c_custkey", (F.col("c_nationkey") % 11).alias("place"), (F.col("c_nationkey") % 6).alias("domain"), tags.alias("tags"))
    size, none = F.col("p_size") % 5, F.expr("array()").cast("array<string>")
    of = lambda *x: F.array(*[F.lit(v) for v in x])
    asks = F.when(size == 1, of("seg:building")).when(size == 2, of("seg:furniture", "even")).when(size == 3, of("even", "age:any")).when(size == 4, of("seg:machinery")).otherwise(F.when(F.col("p_partkey") % 5 == 1, of("nobody")).otherwise(none))
    tasks = part.select(F.col("p_partkey").alias("task_id"), (F.col("p_partkey") % 23).alias("place"), (F.col("p_partkey") % 5).alias("domain"), asks.alias("tags"))
    return picks.pick(people, tasks, key="c_custkey", levels=(("place", "domain"), ("domain",)))


@query(
    "WITH RECURSIVE lists AS (SELECT c_nationkey AS nation, c_mktsegment AS genre, list_sort(list(c_name)) AS angles FROM customer WHERE c_custkey % 3 = 0 OR c_mktsegment < 'F' GROUP BY ALL), "
    "wanted AS (SELECT nation, 10 + nation % 20 AS target FROM (SELECT DISTINCT nation FROM lists)), "
    "rounds AS (SELECT l.nation, genre, 1 AS n, angles[1] AS angle, row_number() OVER (PARTITION BY l.nation ORDER BY genre) - 1 AS slot, count(*) OVER (PARTITION BY l.nation) AS used FROM lists l "
    "UNION ALL SELECT l.nation, l.genre, r.n + 1, l.angles[r.n + 1], r.used + row_number() OVER (PARTITION BY l.nation ORDER BY l.genre) - 1, r.used + count(*) OVER (PARTITION BY l.nation) "
    "FROM (SELECT DISTINCT nation, n, used FROM rounds) r JOIN lists l ON l.nation = r.nation AND len(l.angles) > r.n) "
    "SELECT nation, CAST(slot AS INTEGER) AS slot, genre, angle FROM rounds JOIN wanted USING (nation) WHERE slot < target"
)
def document_plans(spark, sf_dir):
    """Slots of a nation's plan over its segments in turn; the SQL goes round by round."""
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0 or c_mktsegment < 'F'")
    lists = c.groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list("c_name")).alias("angles"))
    products = lists.groupBy(F.col("c_nationkey").alias("nation")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_mktsegment").alias("genre"), "angles"))).alias("genres"))
    return picks.document_plan(products.withColumn("target_docs", F.col("nation") % 20 + 10), key="nation")


_PLACES = {"pt_BR": ["SP", "são paulo", "Ceara", "Mato Grosso do Sul, interior", "nowhere", None], "en_GB": ["London", "wales", "East of England", "Northern  Ireland", "Bayern", ""], "de_DE": ["Bayern", "THÜRINGEN", "sachsen-anhalt", "Sachsen (Ost)", "London", " "]}
_WANTED = {"pt_BR": ["southeast", "southeast", "northeast", "central-west", None, None], "en_GB": ["england", "wales", "england", "northern-ireland", None, None], "de_DE": ["bayern", "thueringen", "sachsen-anhalt", "sachsen", None, None]}
_TEXT = lambda x: "NULL" if x is None else f"'{x}'"


@query(
    "SELECT c_custkey, CASE c_nationkey % 3 " + " ".join(f"WHEN {i} THEN ([{', '.join(map(_TEXT, own))}])[c_custkey % 6 + 1]" for i, own in enumerate(_WANTED.values())) + " END AS region_tag FROM customer"
)
def gazetteer_regions(spark, sf_dir):
    places = F.array(*[F.array(*[F.lit(x) for x in own]) for own in _PLACES.values()])
    of = F.col("c_nationkey") % 3
    people = table(spark, sf_dir, "customer").select("c_custkey", F.get(F.array(*[F.lit(x) for x in _PLACES]), of.cast("int")).alias("locale"), F.get(F.get(places, of.cast("int")), (F.col("c_custkey") % 6).cast("int")).alias("region"))
    return persona.regions(people, persona.gazetteer(spark), fields=["region"]).select("c_custkey", "region_tag")


# --- populations and items ---------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT unnest(['a', 'b', 'c', 'd']) AS conversation_locale, unnest(['BUILDING', 'Angrezi', 'MACHINERY', 'NOWHERE']) AS language) "
    "SELECT conversation_locale, 'c_mktsegment' AS language_column, language, count(c_custkey) AS eligible_rows, (SELECT count(*) FROM customer) AS total_rows, round(100.0 * count(c_custkey) / (SELECT count(*) FROM customer), 6) AS eligible_percent "
    "FROM l LEFT JOIN (SELECT c_custkey, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Angrezi' ELSE c_mktsegment END AS c_mktsegment FROM customer) c ON c.c_mktsegment = l.language GROUP BY ALL"
)
def language_populations(spark, sf_dir):
    """Segments play languages; one is spelled in the corpus' own way."""
    people = table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "FURNITURE", "Angrezi").otherwise(F.col("c_mktsegment")))
    tables = {"labels": {"a": "BUILDING Latin", "b": "Indian English", "c": "MACHINERY", "d": "NOWHERE", "e": ""}, "corpora": {"own": populations.Corpus("c_mktsegment", {"English": "Angrezi"})}}
    made = populations.language_populations(people, ["a", "b", "c", "d", "e"], "own", **tables)
    return made.withColumn("eligible_percent", F.round("eligible_percent", 6))


@query(
    "WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') || CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN chr(10) || '[{\"name\":\"f' || turn || '\"}]' ELSE '' END AS t FROM conversations WHERE role IN ('user', 'assistant')), "
    "w AS (SELECT conv_id, role, sum(length(t)) + count(*) - 1 AS n FROM m GROUP BY ALL), c AS (SELECT DISTINCT conv_id FROM conversations), "
    "a AS (SELECT * FROM (VALUES ('assistant_model', 'assistant'), ('user_model', 'user'), ('api_response_model', 'tool')) v(alias, role)) "
    "SELECT alias, count(*) AS n_rows, 0 AS n_unreadable, CAST(coalesce(sum(n), 0) AS BIGINT) AS visible_tokens FROM c CROSS JOIN a LEFT JOIN w ON w.conv_id = c.conv_id AND w.role = a.role GROUP BY alias"
)
def shown_characters(spark, sf_dir):
    """What each alias shows, tool calls too, in characters."""
    c = table(spark, sf_dir, "conversations")
    calls = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.array(F.struct(F.concat(F.lit("f"), F.col("turn").cast("string")).alias("name"))))
    one = F.struct("turn", F.struct("role", F.col("text").alias("content"), calls.alias("tool_calls")).alias("m"))
    rows = c.groupBy("conv_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["m"])).alias("conversation_messages"))
    return populations.visible_tokens(rows, count=F.length)


@query(
    "WITH i AS (SELECT doc_id // 4 AS t, doc_id % 4 AS p, source AS item, CASE WHEN doc_id % 7 > 0 THEN doc_id % 5 + 1 END AS s, CASE WHEN doc_id % 3 > 0 THEN 'because ' || doc_id ELSE '' END AS r FROM documents), "
    "k AS (SELECT DISTINCT t FROM i), h AS (SELECT * FROM i WHERE s IS NOT NULL), a AS (SELECT t, count(*) AS n, round(avg(s), 3) AS m FROM h GROUP BY t), "
    "q AS (SELECT t, string_agg(chr(10) || '• \"' || item || '\" (score=' || s || '): ' || r, '' ORDER BY s, p) AS b FROM (SELECT * FROM h WHERE r <> '' QUALIFY row_number() OVER (PARTITION BY t ORDER BY s, p) <= 2) GROUP BY t) "
    "SELECT k.t, 'accuracy' AS axis, coalesce(n, 0) AS n, m AS score, CASE WHEN n IS NULL THEN 'no per-fact scores' WHEN n = 1 THEN (SELECT min(CASE WHEN r = '' THEN 'score=' || s || ' on fact ''' || item || '''' ELSE '[' || item || '] ' || r END) FROM h WHERE h.t = k.t) "
    "ELSE 'Mean ' || m || ' across ' || n || ' facts.' || coalesce(' Lowest scoring:' || b, '') END AS reasoning FROM k LEFT JOIN a ON k.t = a.t LEFT JOIN q ON k.t = q.t"
)
def item_reasons(spark, sf_dir):
    i = F.col("doc_id")
    cell = F.struct(F.when(i % 7 > 0, (i % 5 + 1).cast("double")).alias("score"), F.when(i % 3 > 0, F.concat(F.lit("because "), i.cast("string"))).otherwise("").alias("reasoning"))
    entries = table(spark, sf_dir, "documents").select(F.expr("doc_id div 4").alias("t"), (i % 4).alias("position"), F.col("source").alias("item_id"), F.create_map(F.lit("accuracy"), cell).alias("scores"))
    return judging.item_reasons(entries, "t", ["accuracy"])


@query(
    "WITH p AS (SELECT c_custkey, c_custkey % 90 AS a, lower(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN ' auditor' ELSE ' worker' END AS work, c_custkey % 4 = 0 AS money, c_custkey % 3 AS school, 'n' || c_nationkey AS region FROM customer), "
    "l AS (SELECT *, CASE WHEN school = 0 OR (school = 1 AND money) THEN 'high' WHEN school = 2 AND NOT money THEN 'low' ELSE 'medium' END AS literacy FROM p) "
    "SELECT c_custkey, 'age:' || CASE WHEN a < 25 THEN '18-24' WHEN a < 35 THEN '25-34' WHEN a < 45 THEN '35-44' WHEN a < 55 THEN '45-54' WHEN a < 65 THEN '55-64' ELSE '65+' END || ',region:' || region || ',occupation-family:' || replace(work, ' ', '_') || ',financial-literacy:' || literacy AS tags, "
    "1 + CASE WHEN literacy = 'low' THEN 0.5 ELSE 0 END AS bank, 1 + CASE WHEN a < 35 THEN 0.5 ELSE 0 END + CASE WHEN literacy = 'high' OR money THEN 1 ELSE 0 END AS brokerage, "
    "1 + CASE WHEN a >= 55 THEN 1.5 WHEN a >= 35 THEN 0.5 ELSE 0 END AS retirement, 1 + CASE WHEN a >= 55 THEN 0.75 ELSE 0 END + CASE WHEN literacy = 'high' OR money THEN 1 ELSE 0 END AS wealth FROM l"
)
def customer_profiles(spark, sf_dir):
    i = F.col("c_custkey")
    work = F.concat(F.lower("c_mktsegment"), F.when(i % 4 == 0, " auditor").otherwise(" worker"))
    school = F.when(i % 3 == 0, "Masters degree").when(i % 3 == 1, "high school").otherwise("illiterate")
    c = table(spark, sf_dir, "customer").select(i, (i % 90).cast("string").alias("a"), work.alias("work"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("region"), finance.literacy(school, work).alias("l"))
    w = finance.type_weights(F.col("a"), F.col("work"), F.col("l"))
    of = lambda t: F.element_at(w, t).cast("double")
    return c.select(
        "c_custkey", F.array_join(finance.customer_tags(F.col("a"), F.col("region"), F.col("work"), F.col("l")), ",").alias("tags"),
        of("bank").alias("bank"), of("brokerage").alias("brokerage"), of("retirement_provider").alias("retirement"), of("wealth_manager").alias("wealth"),
    )
