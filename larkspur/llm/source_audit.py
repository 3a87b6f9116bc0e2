"""Divergence of sources: which sources of a language use other words than the rest.

1. Each task counts its texts' terms by language and source and the documents
   that hold them; the sums are the corpus' counts.
2. Terms in enough documents of a language are kept. A group (language, source)
   gives each kept term a smoothed, scaled share; all arithmetic is on integers.
3. Terms above the language's share are ranked by radix selection: histograms
   over the bits of the values narrow each group's k-th value down, histograms
   over UTF-8 bytes narrow the ties at it, until a bounded number of candidates
   is left, which are ranked.
4. The distance of two sources is taken from sparse counts: a term that a source
   lacks has the source's baseline. All terms at their baselines make the first
   part; terms that one of both has are corrected by sums over the source's
   distinct shares; terms that both have by a join on the term.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep_table, prepare

MIN_DOCS, TOP = 30, 50
SMOOTHING, SCALE = 5, 1_000_000_000
#: Term counts that a task holds before it passes them on.
TABLE_ROWS = 300_000
#: Bits of a value, and UTF-8 bytes of an item, that a round of the radix selection looks at.
DIGIT_BITS, DIGIT_BYTES = 10, 2
#: A group with at most so many open candidates is ranked without further rounds.
FEW = 4096
#: Tables of groups up to so many rows (counted) are sent to every task.
BROADCAST_ROWS = 200_000

#: ASCII letters in lower case and all bytes of non-ASCII characters stay; everything else parts terms.
_TERM_BYTES = bytes(x if x >= 128 else ord(chr(x).lower()) if chr(x).isalpha() else 32 for x in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and non-ASCII characters, A-Z as a-z."""
    return text.translate(_TERM_BYTES).split()


def term_counts(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and for each group one row with a null term."""

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def rows():
            for (lang, source), (n, docs) in held.items():
                arrays = [pa.array([lang] * (len(n) + 1)), pa.array([source] * (len(n) + 1)), pa.array([*n, None], pa.binary()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), 0], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                found = terms(text)
                n, in_docs = held[lang, source]
                size -= len(n)
                n.update(found)
                in_docs.update(set(found))
                size += len(n)
                if size + len(held) > TABLE_ROWS:
                    yield from rows()
                    held.clear()
                    size = 0
        yield from rows()

    prepare(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    source = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    counted = source.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
    counted = counted.groupBy("lang", "source", F.col("term").cast("string").alias("term"))
    return counted.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _small(df: DataFrame) -> DataFrame:
    """A kept table as the side of a join that is sent to every task, if its counted rows allow that."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _share(n, total, terms):
    """1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms)), exact; null without terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + SMOOTHING) * F.lit(SCALE).cast("decimal(10,0)"), F.nullif(wide(total + SMOOTHING * terms), wide(F.lit(0)))) + 1


def top_of_groups(values: DataFrame, keys: list[str], k: int, *, few: int = FEW) -> DataFrame:
    """The ``k`` rows of each group with the greatest value (a long from 0), ties by item in UTF-8 order, with their rank.

    ``values`` (``keys``, item, value) must be a kept table with distinct items in a group: it is read once a round. No
    task gets more of a group than a histogram, or ``k`` + ``few`` candidates.
    """
    most = values.agg(F.max("value")).first()[0]
    state = keep_table(values.groupBy(*keys).agg(F.count("*").alias("open"), F.lit(k).cast("long").alias("need"), F.lit(0).cast("long").alias("prefix")), "radix-groups")
    shift = -(-int(most or 0).bit_length() // DIGIT_BITS) * DIGIT_BITS
    up, down = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys).orderBy(F.desc("bin"))

    def chosen(bins: DataFrame, order) -> DataFrame:
        """The bin in which a group's ``need``-th candidate lies (else its last), and what is needed of that bin."""
        ran = bins.withColumn("through", F.sum("in_bin").over(order))
        last = ran.where("through - in_bin < need").groupBy(*keys).agg(F.max_by(F.struct("bin", "need", "through", "in_bin"), "through").alias("b"))
        return last.select(*keys, F.col("b.in_bin").alias("open"), (F.col("b.need") - F.col("b.through") + F.col("b.in_bin")).alias("need"), F.col("b.bin").alias("bin"))

    # a group that has few candidates left stops at the bits it has: state keeps the shift of its prefix
    state = state.withColumn("shift", F.lit(shift))
    while shift > 0 and not state.where(F.col("open") > few).isEmpty():
        shift -= DIGIT_BITS
        going = F.col("open") > few
        bins = values.join(_small(state.where(going)), keys).where(F.expr(f"shiftright(value, {shift + DIGIT_BITS})") == F.col("prefix"))
        bins = bins.groupBy(*keys, "need", F.expr(f"shiftright(value, {shift})").alias("bin")).agg(F.count("*").alias("in_bin"))
        found = chosen(bins, down).select(*keys, "open", "need", F.col("bin").alias("prefix"), F.lit(shift).alias("shift"))
        state = keep_table(found.unionByName(state.where(~going)), "radix-bits")
    state = state.withColumn("bytes", F.lit(""))

    # groups that still have more: all open candidates have the same value, so their bytes decide
    text = F.hex(F.encode("item", "UTF-8"))
    while not state.where(F.col("open") > few).isEmpty():
        going = F.col("open") > few
        tied = values.join(_small(state.where(going)), keys).where((F.col("value") == F.col("prefix")) & F.startswith(text, "bytes")).withColumn("text", text)
        # hexadecimal digits that all candidates share are skipped
        ends = keep_table(tied.groupBy(*keys).agg(F.min("text").alias("lo"), F.max("text").alias("hi")), "radix-ends")
        shared = F.expr("aggregate(sequence(1, greatest(length(lo), 1)), 0, (n, i) -> CASE WHEN n = i - 1 AND i <= length(lo) AND substr(lo, i, 1) = substr(hi, i, 1) THEN i ELSE n END)")
        ends = ends.select(*keys, (F.floor(shared / 2) * 2).cast("int").alias("skip"))
        tied = tied.join(_small(ends), keys).withColumn("bin", F.expr(f"substr(text, 1, skip + {2 * DIGIT_BYTES})"))
        bins = tied.groupBy(*keys, "need", "prefix", "shift", "bin").agg(F.count("*").alias("in_bin"))
        found = chosen(bins, up).join(_small(state.select(*keys, "prefix", "shift")), keys)
        found = found.select(*keys, "open", "need", "prefix", "shift", F.col("bin").alias("bytes"))
        state = keep_table(found.unionByName(state.where(~going)), "radix-bytes")

    reached = F.expr("shiftright(value, shift)")
    beyond = (reached > F.col("prefix")) | ((reached == F.col("prefix")) & (F.substring(text, F.lit(1), F.length("bytes")) <= F.col("bytes")))
    left = values.join(_small(state), keys).where(beyond).select(*keys, "item", "value")
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item")))
    return left.where(F.col("rank") <= k)


def _distances(held: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each two sources of a language, both ways.

    held: (lang, source, term, p, base, terms), kept terms of each group; groups: (lang, source, base, terms).
    """
    ends = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("x"))
    pairs = keep_table(groups.join(_small(ends), "lang").where("source <> other"), "source-pairs")
    # sum of |p - x| over a source's own terms, for every x: running sums over its distinct shares
    steps = held.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    steps = steps.select("lang", "source", F.lit(None).cast("string").alias("other"), F.col("p").alias("v"), "m")
    asked = pairs.select("lang", "source", "other", F.col("x").alias("v"), F.lit(0).cast("long").alias("m"))
    whole = Window.partitionBy("lang", "source")
    upto = whole.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ran = steps.unionByName(asked)
    ran = ran.select(
        "*", F.sum("m").over(upto).alias("below"), F.sum(F.col("m") * F.col("v")).over(upto).alias("sum_below"),
        F.sum("m").over(whole).alias("every"), F.sum(F.col("m") * F.col("v")).over(whole).alias("sum_every"),
    )
    own = ran.where("other is not null").select("lang", "source", "other", F.expr("v * (2 * below - every) + sum_every - 2 * sum_below").alias("own"), F.col("every").alias("n_own"))
    own = keep_table(own, "own-distances")
    # what both have
    a = held.select("lang", "term", "source", F.col("p").alias("pa"), F.col("base").alias("ba"))
    b = held.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    both = a.join(b, ["lang", "term"]).where("source < other")
    both = both.groupBy("lang", "source", "other").agg(F.sum(F.expr("abs(pa - pb) - abs(pa - bb) - abs(ba - pb) + abs(ba - bb)")).alias("both"))
    one = pairs.where("source < other").join(own, ["lang", "source", "other"])
    back = own.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), F.col("own").alias("own_back"), F.col("n_own").alias("n_back"))
    one = one.join(back, ["lang", "source", "other"]).join(both, ["lang", "source", "other"], "left")
    value = F.expr("(terms - n_own - n_back) * abs(base - x) + own + own_back + coalesce(both, 0)")
    one = one.select("lang", "source", F.col("other").alias("item"), value.alias("value"))
    ways = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return one.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value")


def audit_sources(
    docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", few: int = FEW
) -> DataFrame:
    """lang, source, part, item, value, rank: by group (language, source) its distances from the language's other
    sources (part ``pair``, all of them), and the ``top`` terms that it uses most beyond the language (part ``term``).

    Kept are the terms in at least ``min_docs`` documents of their language. A group's share of a term with n
    occurrences is 1 + floor(10**9 * (n + 5) / (N + 5 * V)), N its occurrences of the V kept terms; a distance is the
    sum of the shares' absolute differences, 0 without kept terms; a term's value is what its share exceeds the
    language's by, and only terms that do and occur count. Ranks go by falling value, then by the item's UTF-8 bytes.

    Nulls in the three columns count as empty texts, repeated rows as further documents, other columns are ignored. A
    group without terms has the baseline for every term. A language with one source has no pairs; an empty table gives
    an empty result.
    """
    counts = keep_table(term_counts(docs, lang_col=lang_col, source_col=source_col, text_col=text_col), "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"))
    kept = keep_table(kept.where(F.col("docs") >= min_docs).select("lang", "term", "in_lang"), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    held = keep_table(counts.where("term is not null").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "held-terms")
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    base = F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(0))
    groups = keep_table(groups.withColumn("base", base), "source-groups")
    share, lang_share = _share(F.col("n"), F.col("total"), F.col("terms")), _share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    held = held.join(_small(groups), ["lang", "source"]).select("lang", "source", "term", "base", share.alias("p"), lang_share.alias("q"))
    held = keep_table(held, "term-shares")

    above = held.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = top_of_groups(keep_table(above, "terms-above"), ["lang", "source"], top, few=few)
    far = _distances(held, groups.select("lang", "source", "base", "terms"))
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(far, "pair").unionByName(columns(best, "term"))
