"""Mentions of a vocabulary's entries in texts, as spans, and the developers that claims refer to.

A text is cut into pieces: runs of ASCII letters and digits, runs of white space,
and single other characters. An entry is a run of pieces, so it can only be found
at a piece that some entry begins with, and only as many pieces long as such
entries are. Those runs (and no others) leave the texts with their places and
join the entries by equality, however many entries there are. Overlapping
mentions are then resolved within a text: leftmost first, of those the longest.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode_forms import fold_name, with_form
from ..shipping import ship

_PIECE = re.compile(r"[0-9A-Za-z]+|\s+|.", re.DOTALL)
#: Entries' first pieces are sent to every task up to so many (counted); beyond, runs of every length in use are made.
STARTS = 1_000_000
#: Entries up to so many (counted) are joined by broadcast.
BROADCAST_ROWS = 200_000
#: Runs that a task holds before it passes them on.
ROWS = 50_000

NO_ENTRY = "unrecognised"


def pieces(text: str) -> list[tuple[int, str]]:
    """(place, piece in lower case) of a text; white space is one space."""
    return [(m.start(), " " if (p := m.group()).isspace() else p.lower()) for m in _PIECE.finditer(text)]


def entries(names: DataFrame) -> DataFrame:
    """(entry, developer, ambiguous, place, n_pieces, start) of ``names`` (developer, name, ambiguous, place).

    Names are folded; of equal entries the one with the smallest place stays. An entry is ambiguous (also an ordinary
    word) if its developer has a name marked so that folds to it. Blank names are none.
    """
    folded = with_form(names.where("name is not null"), "name", "name", "_entry").where("_entry <> ''")
    marked = folded.groupBy("_entry", "developer").agg(F.bool_or(F.coalesce("ambiguous", F.lit(False))).alias("ambiguous"), F.min("place").alias("place"))
    first = marked.groupBy("_entry").agg(F.min(F.struct("place", "developer", "ambiguous")).alias("e"))
    parts = F.regexp_extract_all("_entry", F.lit("(?s)[0-9a-z]+| |."), F.lit(0))
    return first.select(F.col("_entry").alias("entry"), "e.developer", "e.ambiguous", "e.place", F.size(parts).alias("n_pieces"), F.get(parts, F.lit(0)).alias("start"))


def _runs(texts: DataFrame, known: DataFrame, key: Sequence[str], text: str) -> DataFrame:
    """(key, start, end, entry): the runs of pieces that may be entries."""
    spark = texts.sparkSession
    ship(spark)
    by_start = known.groupBy("start").agg(F.collect_set("n_pieces").alias("n"))
    few = by_start.limit(STARTS + 1).collect()
    if len(few) <= STARTS:
        shared, every = spark.sparkContext.broadcast({r.start: sorted(r.n) for r in few}), None
    else:
        shared, every = None, sorted(r[0] for r in known.select("n_pieces").distinct().collect())
    names = [*key, "start", "end", "entry"]
    source = texts.where(F.col(text).isNotNull()).select(*key, F.col(text).cast("string").alias("_text"))

    def run(batches):
        starts = shared.value if shared is not None else None
        for batch in batches:
            rows, begins, ends, runs = [], [], [], []

            def made(batch=batch):
                own = batch.select(list(range(len(key)))).take(pa.array(rows, pa.int32()))
                return pa.RecordBatch.from_arrays([*own.columns, pa.array(begins, pa.int32()), pa.array(ends, pa.int32()), pa.array(runs, pa.string())], names=names)

            for at, t in enumerate(batch.column(len(key)).to_pylist()):
                found = pieces(t)
                words = [p for _, p in found]
                places = [p for p, _ in found] + [len(t)]
                for i, word in enumerate(words):
                    for n in every if starts is None else starts.get(word, ()):
                        if i + n <= len(words):
                            rows.append(at)
                            begins.append(places[i])
                            ends.append(places[i + n])
                            runs.append("".join(words[i : i + n]))
                if len(rows) >= ROWS:
                    yield made()
                    rows, begins, ends, runs = [], [], [], []
            yield made()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{kinds}, start int, end int, entry string")


def mentions(texts: DataFrame, known: DataFrame, key: Sequence[str], *, text: str = "text", guess: str | None = None, ambiguous: bool = False, overlapping: bool = False) -> DataFrame:
    """(key, start, end, entry, developer): where texts mention entries of ``known`` (see ``entries``).

    start and end count characters of the text as written; any case and any white space between words match, and an
    entry that begins or ends with an ASCII letter or digit isn't found inside a longer run of these. Ambiguous entries
    count with ``ambiguous``, or if the column ``guess`` (what a reader of the text took it for) names their developer.
    Overlapping mentions give way to the leftmost, of equal starts the longest, unless ``overlapping``. Null texts
    mention nothing; rows that share a key are one text's rows as far as overlaps go.
    """
    kept = [*key, *([guess] if guess else [])]
    words = known.select("entry", "developer", "ambiguous")
    words = F.broadcast(words) if words.count() <= BROADCAST_ROWS else words
    found = _runs(texts, known, kept, text).join(words, "entry")
    if not ambiguous:
        plain = ~F.col("ambiguous")
        found = found.where(plain | F.col("developer").eqNullSafe(F.col(guess)) if guess else plain)
    found = found.select(*key, "start", "end", "entry", "developer")
    if overlapping:
        return found
    spans = F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg_end"), "entry", "developer")))
    keep = lambda s, x: F.when((F.size(s) == 0) | (x["start"] >= -F.element_at(s, -1)["neg_end"]), F.concat(s, F.array(x))).otherwise(s)
    grouped = found.groupBy(*key).agg(spans.alias("_s"))
    none = F.filter("_s", lambda _: F.lit(False))
    kept_spans = grouped.select(*key, F.explode(F.aggregate("_s", none, keep)).alias("s"))
    return kept_spans.select(*key, "s.start", (-F.col("s.neg_end")).alias("end"), "s.entry", "s.developer")


def named_developers(texts: DataFrame, known: DataFrame, key: Sequence[str], *, text: str = "text", ambiguous: bool = False) -> DataFrame:
    """(key, developers): the sorted developers that a text's folded form names; texts that name none have no row."""
    folded = with_form(texts, text, "name", "_folded")
    found = mentions(folded, known, key, text="_folded", ambiguous=ambiguous, overlapping=True)
    return found.groupBy(*key).agg(F.array_sort(F.collect_set("developer")).alias("developers"))


def _referred(claims: DataFrame, known: DataFrame, text: str, guess: str) -> DataFrame:
    """(_text, _guess, _dev): the developer of each distinct pair of text and guess; pairs without one are left out."""
    pairs = claims.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), F.col(guess).alias("_guess")).distinct()
    pairs = with_form(pairs, "_text", "name", "_folded")
    found = _runs(pairs.select("_folded").distinct(), known, ["_folded"], "_folded").select("_folded", "entry").distinct()
    words = known.select("entry", "developer", "ambiguous", "place")
    found = found.join(F.broadcast(words) if words.count() <= BROADCAST_ROWS else words, "entry")
    whole = F.col("entry") == F.col("_folded")
    found = found.withColumn("_whole", F.bool_or(whole).over(Window.partitionBy("_folded"))).where(~F.col("_whole") | whole)
    hits = pairs.join(found, "_folded").where(~F.col("ambiguous") | F.col("developer").eqNullSafe(F.col("_guess")))
    best = hits.groupBy("_text", "_guess").agg(F.min(F.struct((-F.length("entry")).alias("n"), "place", "developer")).alias("b"))
    return best.select("_text", "_guess", F.col("b.developer").alias("_dev"))


def claimed_developers(claims: DataFrame, known: DataFrame, *, developer_text: str = "developer_text", model_text: str = "model_text", guess: str = "developer_guess") -> DataFrame:
    """``claims`` with ``developer`` and ``matched_by``: developer_text, model_text, guess or none.

    A text refers to the developer of the entry that it is, else of the longest entry in it; ambiguous entries count
    only where the guess names the same developer. The developer's name decides, then the model's, then the guess if
    it is a developer of the vocabulary; else claims with a text are ``unrecognised`` and others have no developer.
    Repeated claims keep their rows.
    """
    has = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = claims.withColumns({"_d": has(developer_text), "_m": has(model_text)})
    for column, name in (("_d", "_by_developer"), ("_m", "_by_model")):
        one = _referred(rows, known, column, guess).withColumnRenamed("_dev", name)
        rows = rows.join(one, (F.col(column) == F.col("_text")) & F.col(guess).eqNullSafe(F.col("_guess")), "left").drop("_text", "_guess")
    rows = rows.join(known.select(F.col("developer").alias("_known")).distinct(), F.col(guess) == F.col("_known"), "left")
    any_text = F.coalesce("_d", "_m").isNotNull()
    by = F.when(F.col("_by_developer").isNotNull(), developer_text).when(F.col("_by_model").isNotNull(), model_text).when(F.col("_known").isNotNull(), "guess").otherwise("none")
    developer = F.coalesce("_by_developer", "_by_model", "_known", F.when(any_text, NO_ENTRY))
    return rows.withColumns({"developer": developer, "matched_by": by}).drop("_d", "_m", "_by_developer", "_by_model", "_known")


def passages(found: DataFrame, texts: DataFrame, key: Sequence[str], *, text: str = "text", around: int = 80) -> DataFrame:
    """(key, start, end, passage): mentions with ``around`` characters on both sides, overlapping ones as one passage."""
    wide = found.select(*key, F.greatest(F.col("start") - around, F.lit(0)).alias("start"), (F.col("end") + around).alias("end")).distinct()
    order = Window.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    wide = wide.withColumn("_opens", opens).withColumn("_n", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = wide.groupBy(*key, "_n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    rows = spans.join(texts.select(*key, F.col(text).alias("_text")), list(key))
    end = F.least("end", F.length("_text"))
    return rows.select(*key, "start", end.alias("end"), F.substring("_text", F.col("start") + 1, end - F.col("start")).alias("passage"))


__all__ = ["NO_ENTRY", "claimed_developers", "entries", "fold_name", "mentions", "named_developers", "passages", "pieces"]
