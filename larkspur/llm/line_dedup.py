"""Removal of repeated line runs, with DataFrame functions only.

Lines become line ids (two 64-bit hashes), and the places of lines are the
suffixes of the documents. Prefix doubling ranks them by their first 1, 2, 4, ...
lines: a place's rank in a round is the name made of its rank and of that of the
place as many lines ahead. Places with one rank are an interval of suffixes with
so long a common prefix, and the first of them is the copy that stays; a place
whose rank no other has leaves the rounds, so each handles fewer than the one
before, and the last is the one for the longest repeated run. Intervals of 3, 5, ...
lines, needed where short lines only together have enough words, are named from
the rounds' ranks. The longest prefixes that occur earlier, put together where
they follow the same copy, are the maximal repeated runs; their lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep_table

MIN_WORDS = 5
#: A word is a run of characters that aren't spaces; in scripts that are written without spaces every character is one.
WORD = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|[^ \u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+"


def _name(*parts: Column) -> Column:
    """Two independent 64-bit hashes as one id."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _words(line: Column) -> Column:
    # Without two spaces in a row, or one at an end, spaces tell the number of words.
    spaced = F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1
    plain = ~F.contains(line, F.lit("  ")) & ~line.startswith(" ") & ~line.endswith(" ") & ~line.rlike("[\u0e00-\uffff]")
    return F.when(plain, spaced).otherwise(F.regexp_count(line, F.lit(WORD)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per line that isn't blank: doc, sig, i (number among those lines), n (id), w (words)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    line = lambda x: F.when(F.trim(x) != "", F.struct(_name(x).alias("n"), _words(x).alias("w")))
    rows = F.filter(F.transform(_lines(text), line), lambda s: s.isNotNull())
    # the digest comes first, so that the text doesn't go along with each of its lines
    made = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("sig"), rows.alias("rows")).select("doc", "sig", F.posexplode("rows").alias("i", "s"))
    return made.select("doc", "sig", "i", "s.n", "s.w")


def _ranked(places: DataFrame) -> DataFrame:
    """``places`` with ``first``: the least place of equal ``n``; places whose ``n`` occurs once are left out."""
    place = F.struct("d.doc", "d.sig", "i")
    firsts = places.groupBy("n").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    # both are read back, so that Spark can split a hot name's rows in the join
    return places.join(keep_table(firsts, "repeated-names"), "n")


def repeated_runs(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, sig, start, n_lines, first_doc, first_sig, first_start): the maximal runs of lines that occur earlier, too.

    Lines are those that aren't blank, counted from 0; a run has ``min_words`` words at least, and first_* is the place of
    the copy that it follows. sig is a hash of the text that tells rows of one id apart.
    """
    lines = _line_table(docs, id_col, text_col).distinct()
    lines = keep_table(lines.select(F.struct("doc", "sig").alias("d"), "i", "n", "w"), "lines")  # both sides of the first ranking read it
    every = keep_table(_ranked(lines), "repeated-lines")
    here = F.struct("d.doc", "d.sig", "i")
    window = lambda k: F.struct(F.lit(k).alias("k"), "first")
    later = (F.col("w") >= min_words) & (F.col("first") < here)
    found = every.where(later).select("d", "i", window(1).alias("r"))

    by_doc = Window.partitionBy("d").orderBy("i")
    ahead = lambda c, k: F.max(c).over(by_doc.rangeBetween(k, k))
    # of 3, 5, ... lines, where one is too short to count alone; those of 2, 4, ... come from the rounds
    runs, lengths = every.select("d", "i", F.col("n").alias("n1"), F.col("w").alias("w1"), (F.col("w") < min_words).alias("s1")), [1]
    for length in range(2, min_words + 1):
        a = max(p for p in lengths if p & (p - 1) == 0 and p < length)
        b = length - a
        runs = runs.withColumns({
            f"n{length}": F.when(ahead(f"n{b}", a).isNotNull(), _name(F.col(f"n{a}"), ahead(f"n{b}", a))),
            f"w{length}": F.col(f"w{a}") + ahead(f"w{b}", a),
            f"s{length}": F.col(f"s{a}") | ahead(f"s{b}", a),
        })
        lengths.append(length)
    odd = [k for k in lengths[1:] if k & (k - 1)]
    if odd:
        wide = [F.when(F.col(f"n{k}").isNotNull() & (F.col(f"w{k}") >= min_words) & F.col(f"s{k}"), F.struct(F.lit(k).alias("k"), _name(F.lit(k), F.col(f"n{k}")).alias("n"))) for k in odd]
        some = runs.select("d", "i", F.explode(F.filter(F.array(*wide), lambda s: s.isNotNull())).alias("r")).select("d", "i", F.col("r.k").alias("k"), F.col("r.n").alias("n"))
        some = _ranked(keep_table(some, "short-runs")).where(F.col("first") < here)
        found = found.unionByName(some.select("d", "i", F.struct("k", "first").alias("r")))

    places, k = every.select("d", "i", "n", "w"), 1
    while True:
        pairs = places.withColumns({"_n": ahead("n", k), "_w": ahead("w", k)}).where("_n is not null")
        pairs = keep_table(pairs.select("d", "i", _name(F.col("n"), F.col("_n")).alias("n"), (F.col("w") + F.col("_w")).alias("w")), "doubled-runs")
        ranked = keep_table(_ranked(pairs), "repeated-runs")
        k *= 2
        if ranked.isEmpty():
            break
        found = found.unionByName(ranked.where(later).select("d", "i", window(k).alias("r")))
        places = ranked.select("d", "i", "n", "w")

    longest = found.groupBy("d", "i").agg(F.max("r").alias("r"))
    longest = longest.select("d", "i", "r.k", F.struct("r.first.doc", "r.first.sig").alias("f"), (F.col("r.first.i") - F.col("i")).alias("shift"))
    same = Window.partitionBy("d", "f", "shift").orderBy("i")
    reach = F.max(F.col("i") + F.col("k")).over(same.rowsBetween(Window.unboundedPreceding, -1))
    opens = longest.withColumn("opens", F.when(reach.isNull() | (F.col("i") > reach), 1).otherwise(0))
    opens = opens.withColumn("run", F.sum("opens").over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    made = opens.groupBy("d", "f", "shift", "run").agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("k")).alias("stop"))
    return made.select("d.doc", "d.sig", "start", (F.col("stop") - F.col("start")).alias("n_lines"), F.col("f.doc").alias("first_doc"), F.col("f.sig").alias("first_sig"), (F.col("start") + F.col("shift")).alias("first_start"))


def dedup_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` without later copies of repeated line runs, and n_lines, n_removed (long).

    A line goes where it lies in a run of lines that aren't blank, with at least
    ``min_words`` words (``WORD``) in all, that also occurs earlier (by id,
    then line; a null id comes first; rows with one id by a hash of their text).
    Blank lines stay and don't part a run. n_lines counts lines that aren't
    blank. Null texts stay null with 0 lines; rows that repeat id and text are
    one document and are treated alike; other columns pass through (columns
    named n_lines or n_removed are replaced); an empty table stays empty.
    """
    runs = repeated_runs(docs, min_words=min_words, id_col=id_col, text_col=text_col)
    gone = runs.groupBy("doc", "sig").agg(F.collect_set(F.struct("start", "n_lines")).alias("gone_runs")).select(F.col("doc").alias("gone_doc"), F.col("sig").alias("gone_sig"), "gone_runs")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.col(f"`{text_col}`")
    sig = F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
    # The row travels as one struct, so that none of its columns can clash with those of the join.
    rows = docs.select(F.col(f"`{id_col}`").alias("own_doc"), sig.alias("own_sig"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    joined = rows.join(gone.hint("shuffle_hash"), F.col("own_doc").eqNullSafe(F.col("gone_doc")) & (F.col("own_sig") == F.col("gone_sig")), "left")
    joined = joined.withColumn("lines", _lines(F.col("row")[text_col]))
    # runs count lines that aren't blank; "numbers" are their places among all lines
    joined = joined.withColumn("numbers", F.filter(F.transform("lines", lambda x, j: F.when(F.trim(x) != "", j)), lambda j: j.isNotNull()))
    within = F.flatten(F.transform("gone_runs", lambda r: F.slice("numbers", r["start"] + 1, r["n_lines"])))
    joined = joined.withColumn("gone_lines", F.sort_array(F.array_distinct(within)))
    joined = joined.withColumn("bounds", F.concat(F.array(F.lit(-1)), F.col("gone_lines"), F.array(F.size("lines"))))
    # what lies between one removed line and the next, so that a long text is gone through once
    between = lambda k: F.slice("lines", F.get("bounds", k) + 2, F.get("bounds", k + 1) - F.get("bounds", k) - 1)
    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("bounds") - 2), between)), "\n")
    n_lines = F.size("numbers").cast("long")
    text = F.col("row")[text_col]
    return joined.select(
        *[(F.when(F.col("gone_lines").isNull(), text).otherwise(kept) if c == text_col else F.col("row")[c]).alias(c) for c in columns],
        n_lines.alias("n_lines"),
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )
