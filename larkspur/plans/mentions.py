"""Queries of vocabulary mentions: openings of conversations are the names, all turns the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vocabulary
from .queries import query
from .views import table

_FOLD = "replace(lower(trim(regexp_replace({}, '\\s+', ' ', 'g'))), 'ß', 'ss')"
_NAMES_SQL = f"""opened AS (SELECT conv_id, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w FROM conversations WHERE turn = 0 AND text IS NOT NULL),
named AS (
    SELECT 'd' || conv_id % 7 AS developer, {_FOLD.format("w[1] || ' ' || w[2]")} AS entry, false AS ambiguous, conv_id * 2 AS place FROM opened WHERE len(w) > 1
    UNION ALL SELECT 'd' || conv_id % 7, {_FOLD.format("w[1]")}, conv_id % 3 = 0, conv_id * 2 + 1 FROM opened),
marked AS (SELECT developer, entry, bool_or(ambiguous) AS ambiguous, min(place) AS place FROM named WHERE entry <> '' GROUP BY ALL),
known AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY entry ORDER BY place) = 1)"""
_HITS_SQL = """spots AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS p FROM texts),
lengths AS (SELECT DISTINCT length(entry) AS n FROM known),
runs AS (SELECT id, t, p, substr(t, p, n) AS entry FROM spots, lengths WHERE p + n - 1 <= length(t)),
hits AS (
    SELECT r.id, p - 1 AS start, p - 1 + length(r.entry) AS stop, k.* FROM runs r JOIN known k ON r.entry = k.entry
    WHERE NOT regexp_matches(CASE WHEN p > 1 THEN substr(t, p - 1, 2) ELSE '' END, '^[0-9a-z][0-9a-z]') AND NOT regexp_matches(substr(t, p + length(r.entry) - 1, 2), '^[0-9a-z][0-9a-z]'))"""


def _known(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    opened = table(spark, sf_dir, "conversations").where("turn = 0 and text is not null").select("conv_id", words.alias("w"))
    developer = F.concat(F.lit("d"), (F.col("conv_id") % 7).cast("string"))
    two = opened.where(F.size("w") > 1).select(developer.alias("developer"), F.concat_ws(" ", F.slice("w", 1, 2)).alias("name"), F.lit(False).alias("ambiguous"), (F.col("conv_id") * 2).alias("place"))
    one = opened.select(developer.alias("developer"), F.col("w")[0].alias("name"), (F.col("conv_id") % 3 == 0).alias("ambiguous"), (F.col("conv_id") * 2 + 1).alias("place"))
    return vocabulary.entries(two.union(one))


def _guessed(spark, sf_dir):
    return table(spark, sf_dir, "conversations").withColumn("guess", F.concat(F.lit("d"), (F.col("turn") % 9).cast("string")))


@query(
    f"WITH RECURSIVE {_NAMES_SQL}, texts AS (SELECT (conv_id, turn) AS id, regexp_replace(lower(text), '\\s', ' ', 'g') AS t FROM conversations), {_HITS_SQL}, "
    "counted AS (SELECT id, {'s': start, 'n': -stop, 'entry': entry, 'developer': developer} AS h FROM hits WHERE NOT ambiguous OR developer = 'd' || id[2] % 9), "
    "steps AS (SELECT id, min(h) AS h FROM counted GROUP BY id UNION ALL SELECT c.id, min(c.h) AS h FROM steps s JOIN counted c ON c.id = s.id AND c.h.s >= -s.h.n GROUP BY c.id) "
    'SELECT id[1] AS conv_id, id[2] AS turn, CAST(h.s AS INTEGER) AS start, CAST(-h.n AS INTEGER) AS "end", h.entry AS entry, h.developer AS developer FROM steps'
)
def mention_spans(spark, sf_dir):
    """Leftmost-longest mentions; the SQL tries every position with every length."""
    return vocabulary.mentions(_guessed(spark, sf_dir), _known(spark, sf_dir), ["conv_id", "turn"], guess="guess")


@query(
    f"WITH {_NAMES_SQL}, texts AS (SELECT (conv_id, turn) AS id, {_FOLD.format('text')} AS t FROM conversations), {_HITS_SQL} "
    "SELECT id[1] AS conv_id, id[2] AS turn, array_to_string(list_sort(list(DISTINCT developer)), ',') AS developers FROM hits WHERE NOT ambiguous GROUP BY id"
)
def named_developers(spark, sf_dir):
    found = vocabulary.named_developers(table(spark, sf_dir, "conversations"), _known(spark, sf_dir), ["conv_id", "turn"])
    return found.withColumn("developers", F.array_join("developers", ","))


_CLAIMED_SQL = f"""said AS (SELECT conv_id, turn, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS w, 'd' || turn % 9 AS guess FROM conversations WHERE text IS NOT NULL),
claims AS (SELECT conv_id, turn, guess, nullif(array_to_string(w[1:CASE WHEN turn % 2 = 0 THEN 1 ELSE 4 END], ' '), '') AS d, CASE WHEN turn % 3 > 0 THEN nullif(array_to_string(w[5:8], ' '), '') END AS m FROM said),
texts AS (SELECT DISTINCT x AS id, {_FOLD.format("x")} AS t FROM (SELECT d AS x FROM claims UNION SELECT m FROM claims) WHERE x IS NOT NULL),
{_HITS_SQL},
exact AS (SELECT *, bool_or(entry = t) OVER (PARTITION BY id) AS whole, entry = t AS is_whole FROM (SELECT h.*, x.t FROM hits h JOIN texts x ON h.id = x.id)),
pairs AS (SELECT DISTINCT x, guess FROM (SELECT d AS x, guess FROM claims UNION SELECT m, guess FROM claims) WHERE x IS NOT NULL),
meant AS (SELECT x, guess, arg_min(developer, (-length(entry), place)) AS dev FROM pairs JOIN exact ON id = x WHERE (is_whole OR NOT whole) AND (NOT ambiguous OR developer = guess) GROUP BY x, guess)"""


@query(
    f"WITH {_NAMES_SQL}, {_CLAIMED_SQL} SELECT conv_id, turn, coalesce(a.dev, b.dev, CASE WHEN c.guess IN (SELECT developer FROM known) THEN c.guess END, CASE WHEN d IS NOT NULL OR m IS NOT NULL THEN 'unrecognised' END) AS developer, "
    "CASE WHEN a.dev IS NOT NULL THEN 'developer_text' WHEN b.dev IS NOT NULL THEN 'model_text' WHEN c.guess IN (SELECT developer FROM known) THEN 'guess' ELSE 'none' END AS matched_by "
    "FROM claims c LEFT JOIN meant a ON a.x = d AND a.guess = c.guess LEFT JOIN meant b ON b.x = m AND b.guess = c.guess"
)
def claimed_developers(spark, sf_dir):
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    said = _guessed(spark, sf_dir).where("text is not null").withColumn("w", words)
    d = F.concat_ws(" ", F.when(F.col("turn") % 2 == 0, F.slice("w", 1, 1)).otherwise(F.slice("w", 1, 4)))
    m = F.when(F.col("turn") % 3 > 0, F.concat_ws(" ", F.slice("w", 5, 4)))
    claims = said.select("conv_id", "turn", d.alias("developer_text"), m.alias("model_text"), F.col("guess").alias("developer_guess"))
    return vocabulary.claimed_developers(claims, _known(spark, sf_dir)).select("conv_id", "turn", "developer", "matched_by")
