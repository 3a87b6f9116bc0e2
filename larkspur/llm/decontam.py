"""Benchmark decontamination by windows and templates, with DataFrame functions only.

A text has a word sequence at several levels: its plain lower-case words; numbers
and units as typed placeholders; names inside sentences as well; every capitalised
word as well; and the last with runs of names and of numbers as one placeholder
each. Windows of five are joined by hash at all levels, so that neither case nor
line breaks nor other numbers or names hide an item.

All documents are read once for candidates: their windows, plain, with numbers
and with everything as placeholders, are joined with those of the items at every
level, and a text whose matches cover enough of an item's words, wherever they
are, is a candidate. In candidates, windows that match in one band of offsets
between item and document are counted together, so an inserted or removed word
only costs the windows it is in. The values in the slots must map one to one:
windows that map a value to another than most, or two values to one, don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import keep_table

WINDOW_WORDS = 5
SHARE = 0.8
#: So many windows in one band of offsets (13 words in a row have 9) are enough of a long item.
ENOUGH_WINDOWS = 9
#: A document whose matches cover this share of an item's words, or so many of them, is a candidate.
CANDIDATE_SHARE, CANDIDATE_WORDS = 0.5, 8
#: A benchmark of up to this many windows (counted) is sent to every task; a larger one is joined by shuffle.
BROADCAST_WINDOWS = 200_000
#: So are the ids of up to this many candidates (counted).
BROADCAST_CANDIDATES = 500_000

# Unit words that count as a slot after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh c f k celsius fahrenheit kelvin w kw j kj cal kcal v a hz pa bar percent dollar dollars euro euros cent cents usd eur gbp"
).split()
_NAME, _NUMBER, _UNIT, _START = "\u0001", "\u0002", "\u0003", "\u0004"
#: Levels beside the plain words: which words are placeholders, and which of these are new at the level.
LEVELS = (((_NUMBER, _UNIT), (_NUMBER, _UNIT)), ((_NUMBER, _UNIT, _NAME), (_NAME,)), ((_NUMBER, _UNIT, _NAME, _START), (_START,)))
#: Windows whose offsets differ by up to this, or by a quarter of the item's windows, are always counted together.
BAND_WORDS = 4


def _words(text: Column) -> Column:
    """Words of a text; a capitalised one starts with a mark: a name's after a lower-case letter or comma, else a start's."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\s\u0001-\u0004]+", " ")
    marked = F.regexp_replace(marked, r"(?=\p{Lu})(?<=[\p{Ll},;] )(?=\p{L}*\p{Ll})", _NAME)
    marked = F.regexp_replace(marked, "(?=\\p{Lu})(?<![\\p{L}\\p{M}\\p{N}\u0001])(?=\\p{L}*\\p{Ll})", _START)
    digits = F.regexp_replace(F.regexp_replace(marked, r"(?<=\d)[.,](?=\d)", ""), r"(?<=\d)(?=\p{L})", " ")
    marked = F.when(marked.rlike("[0-9]"), digits).otherwise(marked)
    return F.filter(F.split(F.lower(marked), "[^\\p{L}\\p{M}\\p{N}\u0001\u0004]+"), lambda w: w != "")


def _kinds(words: Column) -> Column:
    """Each word's placeholder, empty for a literal word."""
    number = lambda w: w.rlike(r"^\p{N}")
    capital = lambda w: F.when(F.startswith(w, F.lit(_NAME)), _NAME).when(F.startswith(w, F.lit(_START)), _START)

    def kind(w, j):
        after_number = (j > 0) & F.coalesce(number(F.get(words, j - 1)), F.lit(False))
        return capital(w).when(number(w), _NUMBER).when(after_number & w.isin(UNITS), _UNIT).otherwise("")

    return F.when(F.exists(words, number), F.transform(words, kind)).otherwise(F.transform(words, lambda w: capital(w).otherwise("")))


def _starts(n: Column, size: int) -> Column:
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.expr("array()").cast("array<int>"))


def windows(table: DataFrame, id_col: str, text_col: str, size: int, *, items: bool, short: tuple[int, ...] = ()) -> DataFrame:
    """(id, sig, chan, n, at, h, slots): every window's hash at each level where it is new; slots holds its words in slots
    (null for others), or is null without any. chan 1 are windows with runs as one placeholder: all of an item that has
    runs, those over a run of a document. chan 2 are plain windows of the sizes ``short``; of items, whole texts of fewer
    than ``size`` words. ``at`` counts words, of items in chan 1 placeholders, and n the windows of the channel.
    """
    base = table.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("sig"), _words(F.col(f"`{text_col}`")).alias("words"))
    base = base.select("id", "sig", F.transform("words", lambda w: F.translate(w, _NAME + _START, "")).alias("w"), _kinds(F.col("words")).alias("k"))
    base = base.withColumn("len", F.size("w"))
    # t1, t2, t3: null where the level has nothing new
    for level, (kinds, new) in enumerate(LEVELS, 1):
        made = F.zip_with("w", "k", lambda w, k: F.when(k.isin(*kinds), F.when(k == _START, _NAME).otherwise(k)).otherwise(w))  # noqa: B023
        base = base.withColumn(f"t{level}", F.when(F.exists("k", lambda k: k.isin(*new)), made))  # noqa: B023
    # What a lambda reads for each word is kept first: put into the lambda, it would be made anew for each.
    base = keep_table(base.withColumn("top", F.coalesce("t3", "t2", "t1")), "leak-words")  # top is null for a text of literal words
    joins = lambda i: (i > 0) & F.get("top", i).isin(_NAME, _NUMBER) & F.coalesce(F.get("top", i) == F.get("top", i - 1), F.lit(False))
    some = F.coalesce(F.exists(F.sequence(F.lit(0), F.col("len") - 1), joins), F.lit(False))
    base = base.withColumn("firsts", F.when(F.col("top").isNotNull() & some, F.filter(F.sequence(F.lit(0), F.col("len") - 1), lambda i: ~joins(i))))
    base = base.withColumn("m", F.transform("firsts", lambda i: F.get("top", i)))
    slot = lambda x: x.isin(_NAME, _NUMBER, _UNIT)
    ends = lambda p: F.coalesce(F.get("firsts", p + 1), F.col("len"))
    value = lambda i, p: F.when(slot(F.get("top", i)), F.concat_ws(" ", F.slice("w", i + 1, ends(p) - i)))
    base = keep_table(base.withColumn("mv", F.transform("firsts", value)), "leak-runs")

    def window(chan, n, at, h, slots):
        return F.struct(F.lit(chan).alias("chan"), n.alias("n"), at.alias("at"), h.alias("h"), slots.cast("array<string>").alias("slots"))

    null = F.lit(None)
    n = F.greatest(F.col("len") - (size - 1), F.lit(0))
    every = [F.transform(_starts(F.col("len"), size), lambda j: window(0, n, j, F.xxhash64(F.slice("w", j + 1, size)), null))]
    for level, (kinds, new) in enumerate(LEVELS, 1):
        places = F.filter(_starts(F.col("len"), size), lambda j: F.exists(F.slice("k", j + 1, size), lambda k: k.isin(*new)))  # noqa: B023
        slots = lambda j: F.zip_with(F.slice("w", j + 1, size), F.slice("k", j + 1, size), lambda w, k: F.when(k.isin(*kinds), w))  # noqa: E731, B023
        made = F.transform(places, lambda j: window(0, n, j, F.xxhash64(F.slice(f"t{level}", j + 1, size)), slots(j)))  # noqa: B023
        every.append(F.when(F.col(f"t{level}").isNotNull(), made))
    merged = _starts(F.size("m"), size)
    if not items:
        merged = F.filter(merged, lambda j: F.coalesce(F.get("firsts", j + size), F.col("len")) - F.get("firsts", j) > size)
    n1 = F.greatest(F.size("m") - (size - 1), F.lit(0))
    joined = F.transform(merged, lambda j: window(1, n1, j if items else F.get("firsts", j), F.xxhash64(F.slice("m", j + 1, size)), F.slice("mv", j + 1, size)))
    every.append(F.when(F.col("firsts").isNotNull(), joined))
    if items:
        every.append(F.when(F.col("len").between(1, size - 1), F.array(window(2, F.lit(1), F.lit(0), F.xxhash64("w"), null))))
    for s in short:
        every.append(F.transform(_starts(F.col("len"), s), lambda j: window(2, n, j, F.xxhash64(F.slice("w", j + 1, s)), null)))  # noqa: B023
    none = F.slice(every[0], 1, 0)
    made = F.concat(every[0], *[F.coalesce(x, none) for x in every[1:]])
    return base.select("id", "sig", F.col("len"), F.explode(made).alias("x")).select("id", "sig", "len", "x.*")


# --- candidates: every token is a number, so that windows are formed and hashed by compiled code ----------

_HASHED = {_NUMBER: 1, _UNIT: 2, _NAME: 3}


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _merged_firsts(tokens: Column) -> Column:
    """Places of the tokens but for those that go on a run of names or of numbers."""
    goes_on = lambda i: (i > 0) & F.get(tokens, i).isin(_HASHED[_NAME], _HASHED[_NUMBER]) & (F.get(tokens, i) == F.get(tokens, i - 1))
    return F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: ~F.coalesce(goes_on(i), F.lit(False)))


def _hashed_levels(table: DataFrame, text_col: str) -> DataFrame:
    """``table`` with plain, numbers and top: arrays of longs, one for each word of the text. numbers and top are null
    for a text without numbers, or without placeholders; in top every word with both cases is a name."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(raw, r"(?<=[0-9])[.,](?=[0-9])", ""), r"(?<=[0-9])(?=\p{L})", " ")
    cased = F.array_remove(F.split(F.when(raw.rlike("[0-9]"), digits).otherwise(raw), r"[^\p{L}\p{M}\p{N}]+"), "")
    number = lambda w: (w < ":") | ((w >= "\u0080") & w.rlike(r"^\p{N}"))  # noqa: E731  words begin with letters, marks or numbers
    units = [F.xxhash64(F.lit(u)) for u in UNITS]
    has = lambda c, n: F.array_contains(c, _long(n))

    def with_units(name):
        c = F.col(name)
        unit = lambda i: (i > 0) & (F.get(c, i - 1) == _HASHED[_NUMBER])
        return F.when(has(c, _HASHED[_NUMBER]), F.transform(c, lambda x, i: F.when(unit(i) & x.isin(units), _long(_HASHED[_UNIT])).otherwise(x))).otherwise(c)

    out = table.withColumn("cased", cased).withColumn("plain", F.transform("cased", lambda w: F.xxhash64(F.lower(w))))
    mixed = lambda w: (F.lower(w) != w) & (F.upper(w) != w)
    top = F.zip_with("plain", "cased", lambda h, w: F.when(number(w), _long(_HASHED[_NUMBER])).when(mixed(w), _long(_HASHED[_NAME])).otherwise(h))
    out = out.withColumn("top", top).withColumn("top", with_units("top"))
    numbers = F.zip_with("plain", "top", lambda h, t: F.when(t.isin(_HASHED[_NUMBER], _HASHED[_UNIT]), t).otherwise(h))
    out = out.withColumn("numbers", F.when(has(F.col("top"), _HASHED[_NUMBER]), numbers))
    slots = has(F.col("top"), _HASHED[_NUMBER]) | has(F.col("top"), _HASHED[_NAME])
    return out.withColumn("top", F.when(slots, F.col("top"))).drop("cased")


def _candidates(docs: DataFrame, benchmark: DataFrame, size: int, *, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """(id, sig) of the documents with enough of an item's words in matching windows."""
    names = [f"t{k}" for k in range(size)]

    def zipped(c):
        return F.arrays_zip(*[(F.slice(c, k + 1, 1 << 30) if k else F.col(c)).alias(n) for k, n in enumerate(names)])

    # items: at every level, as it is and with merged runs
    item = benchmark.select(F.col(f"`{item_text_col}`").alias("text"), F.struct(F.col(f"`{item_id_col}`").alias("id"), F.xxhash64(F.col(f"`{item_text_col}`").cast("string"))).alias("item")).distinct()
    item = _hashed_levels(item, "text").withColumns({"w": _words(F.col("text"))})
    item = item.withColumns({"k": _kinds(F.col("w")), "w": F.transform("w", lambda w: F.translate(w, _NAME + _START, ""))})
    mark = lambda k: F.when(k == _NUMBER, _long(1)).when(k == _UNIT, _long(2)).otherwise(_long(3))
    forms = [F.struct(F.lit(c == "plain").alias("plain"), F.col(c).alias("t")) for c in ("plain", "top", "numbers")]
    for kinds, _ in LEVELS:
        forms.append(F.struct(F.lit(False).alias("plain"), F.zip_with("w", "k", lambda w, k: F.when(k.isin(*kinds), mark(k)).otherwise(F.xxhash64(w))).alias("t")))  # noqa: B023
    every = item.withColumn("n", F.size("plain")).where("n > 0").select("item", "n", F.explode(F.array(*forms)).alias("x")).select("item", "n", "x.*").where("t is not null").distinct()
    every = every.withColumn("f", F.explode(F.array(_merged_firsts(F.col("t")), F.sequence(F.lit(0), F.col("n") - 1)))).withColumn("m", F.size("f"))
    whole_item = F.col("plain") & (F.col("m") == F.col("n"))
    every = every.withColumn("j", F.explode(F.when(F.col("m") >= size, F.sequence(F.lit(0), F.col("m") - size)).when(whole_item, F.array(F.lit(0)))))
    at = [F.get("t", F.get("f", F.col("j") + k)) for k in range(size)]
    whole = F.when(F.col("m") == 1, F.xxhash64(at[0]))
    for k in range(2, size):
        whole = whole.when(F.col("m") == k, F.xxhash64(*at[:k]))
    every = every.select(
        "item",
        F.least("n", "m").alias("words"),
        F.get("f", "j").alias("at"),
        F.coalesce(F.get("f", F.col("j") + size), F.col("n")).alias("end"),
        whole.otherwise(F.xxhash64(*at)).alias("h"),
        F.when(F.col("m") < size, F.col("m")).alias("short"),
    )
    every = every.groupBy("item", "at", "end", "h", "short").agg(F.min("words").alias("words"))
    every = keep_table(every.withColumn("need", F.least(F.ceil(F.col("words") * CANDIDATE_SHARE), F.lit(CANDIDATE_WORDS)).cast("int")).drop("words"), "benchmark-hashes")
    short = sorted(r[0] for r in every.where("short is not null").select("short").distinct().collect())

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = _hashed_levels(docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("sig"), text.alias("text")), "text")
    merged = F.transform(_merged_firsts(F.col("top")), lambda i: F.get("top", i))
    own = own.withColumn("merged", merged)
    none = F.slice(zipped("plain"), 1, 0)
    found = own.select("id", "sig", F.inline(F.concat(zipped("plain"), F.coalesce(zipped("numbers"), none), F.coalesce(zipped("merged"), none))))
    hashes = F.when(F.col(names[-1]).isNotNull(), F.xxhash64(*names))
    if short:
        hashes = F.explode(F.array(hashes, *[F.when(F.col(names[s - 1]).isNotNull(), F.xxhash64(*names[:s])) for s in short]))
    found = found.select("id", "sig", hashes.alias("h"))
    few = every.count() <= BROADCAST_WINDOWS
    found = found.join(F.broadcast(every.drop("short")) if few else every.drop("short").hint("shuffle_hash"), "h")
    covered = F.size(F.array_distinct(F.flatten(F.transform("ws", lambda w: F.sequence(w["at"], w["end"] - 1)))))
    found = found.groupBy("id", "sig", "item").agg(F.min("need").alias("need"), F.collect_set(F.struct("at", "end")).alias("ws"))
    return keep_table(found.where(covered >= F.col("need")).select("id", "sig").distinct(), "leak-candidates")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window_words: int = WINDOW_WORDS,
    share: float = SHARE,
    enough_windows: int = ENOUGH_WINDOWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id_col, sig, item_id_col, matched_windows, item_windows, same_values): documents that hold benchmark items.

    A document holds an item where, in one band of offsets, at least ``share`` of
    the item's windows (or ``enough_windows`` of them) match, or windows that
    match hold that share of its words, each value in the item's slots standing for the one value in the document that it mostly stands
    for; same_values tells that the values are equal. Of several bands the best
    is reported. sig is a hash of the document's text. Items of fewer than
    ``window_words`` words match as a whole, word for word, as one window; null
    texts are empty; repeated rows of a document or item count once; empty tables
    give an empty result.
    """
    maybe = _candidates(docs, benchmark, window_words, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col)
    sig = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    maybe = F.broadcast(maybe) if maybe.count() <= BROADCAST_CANDIDATES else maybe.hint("shuffle_hash")
    docs = docs.alias("d").join(maybe.alias("m"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("m.id")) & (sig == F.col("m.sig")), "left_semi")
    items = keep_table(windows(benchmark, item_id_col, item_text_col, window_words, items=True).distinct(), "benchmark-windows")
    short = tuple(sorted(r[0] for r in items.where("chan = 2").select("len").distinct().collect()))
    items = items.select(F.col("id").alias("item"), F.col("sig").alias("item_sig"), "chan", F.col("n").alias("item_n"), F.col("at").alias("item_at"), F.col("h"), F.col("slots").alias("item_slots"))
    small = items.count() <= BROADCAST_WINDOWS
    found = windows(docs, id_col, text_col, window_words, items=False, short=short).select("id", "sig", "at", "h", "slots").join(F.broadcast(items) if small else items.hint("shuffle_hash"), "h")
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("k"), F.col("slots").alias("v")), lambda p: p["k"].isNotNull())
    half = F.greatest(F.lit(BAND_WORDS), F.floor(F.col("item_n") / 4))
    band = F.floor((F.col("at") - F.col("item_at")) / half)
    need = F.least(F.ceil(F.col("item_n") * share), F.lit(enough_windows))
    distinct_at = lambda ws: F.size(F.array_distinct(F.transform(ws, lambda w: w["at"])))
    # an added, removed or other word breaks up to five windows, but their other words lie in other windows
    held_words = lambda ws: F.size(F.array_distinct(F.flatten(F.transform(ws, lambda w: F.sequence(w["at"], w["at"] + (window_words - 1))))))
    enough = lambda ws: (distinct_at(ws) >= need) | (held_words(ws) >= F.ceil((F.col("item_n") + (window_words - 1)) * share))
    runs = (
        found.withColumn("band", F.explode(F.array(band - 1, band)))
        .groupBy("id", "sig", "item", "item_sig", "chan", "item_n", "band")
        .agg(F.collect_set(F.struct(F.col("item_at").alias("at"), F.coalesce(pairs, F.expr("array()").cast("array<struct<k:string,v:string>>")).alias("pairs"))).alias("ws"))
        .where(enough("ws"))
    )
    runs = keep_table(runs, "leak-bands")
    runs = runs.withColumn("values", F.flatten(F.transform("ws", lambda w: w["pairs"])))
    times = lambda p: F.size(F.filter("values", lambda q: q == p))
    mostly = lambda k: F.array_max(F.transform(F.filter(F.array_distinct("values"), lambda p: p["k"] == k), lambda p: F.struct(times(p).alias("n"), p["v"].alias("v"))))
    keys = F.array_distinct(F.transform("values", lambda p: p["k"]))
    runs = runs.withColumn("mostly", F.transform(keys, lambda k: F.struct(mostly(k).alias("m"), k.alias("k"))))
    # of item values that stand for one value of the document, the one that mostly does
    lone = F.filter("mostly", lambda c: ~F.exists("mostly", lambda d: (d["m"]["v"] == c["m"]["v"]) & (d > c)))
    runs = keep_table(runs.withColumn("chosen", F.transform(lone, lambda c: F.struct(c["k"].alias("k"), c["m"]["v"].alias("v")))), "leak-values")
    runs = runs.withColumn("ws", F.filter("ws", lambda w: F.size(F.array_except(w["pairs"], F.col("chosen"))) == 0))
    runs = runs.where(enough("ws")).withColumn("hits", distinct_at("ws"))
    plain = F.array_distinct(F.transform(F.filter("ws", lambda w: F.forall(w["pairs"], lambda p: p["k"] == p["v"])), lambda w: w["at"]))
    best = runs.groupBy("id", "sig", "item").agg(F.max(F.struct("hits", F.col("item_n"), (F.size(plain) == F.col("hits")).alias("same"))).alias("b"))
    return best.select(
        F.col("id").alias(id_col),
        "sig",
        F.col("item").alias(item_id_col if item_id_col != id_col else "item_id"),
        F.col("b.hits").cast("long").alias("matched_windows"),
        F.col("b.item_n").cast("long").alias("item_windows"),
        F.col("b.same").alias("same_values"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, null ids included; columns as they were."""
    held = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **settings).select(F.col(id_col).alias("held_id"), F.col("sig").alias("held_sig")).distinct()
    sig = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit("")))
    return docs.alias("d").join(held.alias("h"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("h.held_id")) & (sig == F.col("h.held_sig")), "left_anti")
