"""A language detector trained on labelled texts: character n-grams, naive Bayes.

Fitting counts distinct words by language first, so n-grams are cut from each
word once, by whole arrays of words in the tasks. The model is a bounded table of n-grams with a log-probability for each
language. Scoring sends that table to the tasks; there a word is cut into n-grams
once, whatever its repeats, sums are made where the texts are, and one row a text is
shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import prepare

#: n-grams are this long; words are padded by a space on both sides.
ORDERS = (1, 2, 3)
#: The model keeps so many n-grams of each length, the most frequent over all languages, each language counting equally.
GRAMS = 20_000
SMOOTHING = 0.5
#: A text's best language must be this much likelier than the next (as a logarithm).
MARGIN = 1.0
#: Fitting cuts at least so many words at a time (but for a task's last); scoring looks at so many words of a text at a time.
WORDS, PIECE = 50_000, 1 << 16


def _grams(words: pa.Array, orders: Sequence[int]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
    """By length: the distinct n-grams of the words, repeats included as two arrays: the number of the n-gram, that of its word."""
    padded = pc.binary_join_element_wise(" ", words, " ", "")
    text = "".join(padded.to_numpy(zero_copy_only=False))
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(words)), pc.utf8_length(padded).to_numpy())
    ids = codes  # equal numbers: equal strings of n characters from there, inside one word
    for n in range(1, max(orders) + 1):
        if n == 1:
            at = np.flatnonzero(codes != ord(" "))
        else:
            at = np.flatnonzero(of[: max(0, len(of) - n + 1)] == of[n - 1 :])
            ids = ids[at] * 0x110000 + codes[at + n - 1]
        which, distinct = pd.factorize(ids[at] if n == 1 else ids)
        if n in orders:
            first = np.empty(len(distinct), int)
            first[which] = at
            yield n, [text[i : i + n] for i in first], which, of[at]
        if n > 1:
            ids = np.zeros(len(codes), np.int64)
            ids[at] = which


def words(text: Column) -> Column:
    """Runs of letters and marks, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}]+)"), F.lit(1))


@dataclass(frozen=True)
class LanguageModel:
    """``table``: (gram, p0, p1, ...) in the order of ``languages``; ``unseen``: by n-gram length, each language's value of others."""

    languages: tuple[str, ...]
    table: DataFrame
    unseen: dict[int, tuple[float, ...]]


def fit(texts: DataFrame, *, text: str = "text", lang: str = "lang", orders: Sequence[int] = ORDERS, keep: int = GRAMS) -> LanguageModel:
    """A model of the texts' languages; rows without text or language aren't learnt from.

    The number of languages must be small (each is a column). The table is at most ``keep`` rows an order.
    """
    rows = texts.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.explode(words(F.col(text))).alias("word"))
    counted = rows.groupBy("lang", "word").agg(F.count("*").alias("n"))
    prepare(texts.sparkSession)

    def cut_words(batches):
        for table in _tables(batches):
            lang, times = table["lang"].combine_chunks().dictionary_encode(), table["n"].to_numpy()
            own, k = lang.indices.to_numpy(), len(lang.dictionary)
            for n, found, which, of in _grams(table["word"].combine_chunks(), orders):
                sums = np.bincount(which * k + own[of], times[of], len(found) * k)
                at = np.flatnonzero(sums)
                grams = pa.array([f"{n}{g}" for g in found]).take(pa.array(at // k))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(at % k)), grams, pa.array(sums[at].astype(np.int64))], names=["lang", "gram", "n"])

    cut = counted.mapInArrow(cut_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    cut = cut.withColumn("order", F.substring("gram", 1, 1).cast("int")).persist()
    try:
        sums = cut.groupBy("lang", "order").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()  # languages times orders
        languages = tuple(sorted({r.lang for r in sums}))
        if not languages:
            raise ValueError("no text with a language to learn from")
        total = {(r.lang, r.order): (r.n, r.kinds) for r in sums}
        floor = lambda k, n: math.log(SMOOTHING / (total.get((k, n), (0, 0))[0] + SMOOTHING * (total.get((k, n), (0, 0))[1] + 1)))
        unseen = {n: tuple(floor(k, n) for k in languages) for n in orders}
        known = texts.sparkSession.createDataFrame([(k, n, float(m), math.log(m + SMOOTHING * (v + 1))) for (k, n), (m, v) in total.items()], "lang string, order int, total double, log_total double")
        shares = cut.join(F.broadcast(known), ["lang", "order"])
        value = F.log(F.col("n") + SMOOTHING) - F.col("log_total")
        wide = shares.groupBy("order", "gram").agg(
            F.sum(F.col("n") / F.col("total")).alias("share"), *[F.max(F.when(F.col("lang") == k, value)).alias(f"p{i}") for i, k in enumerate(languages)]
        )
        parts = [wide.where(F.col("order") == n).orderBy(F.desc("share"), "gram").limit(keep) for n in orders]
        table = parts[0]
        for part in parts[1:]:
            table = table.union(part)
        values = [F.coalesce(f"p{i}", F.element_at(F.create_map(*[x for n in orders for x in (F.lit(n), F.lit(unseen[n][i]))]), F.col("order"))).alias(f"p{i}") for i in range(len(languages))]
        rows = table.select("gram", *values).collect()  # at most ``keep`` rows an order
    finally:
        cut.unpersist()
    schema = "gram string, " + ", ".join(f"p{i} double" for i in range(len(languages)))
    return LanguageModel(languages, texts.sparkSession.createDataFrame(rows, schema), unseen)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to at least ``WORDS`` rows, but for the last."""
    held = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= WORDS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


class _Values:
    """Each language's log-probabilities of words, and how many of a word's n-grams the model knows."""

    def __init__(self, table: list[tuple], unseen: dict[int, tuple[float, ...]]):
        self.rows = np.array([r[1:] for r in table] + list(unseen.values()), float)
        self.place = {r[0]: i for i, r in enumerate(table)}
        self.other = {n: len(table) + k for k, n in enumerate(unseen)}

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, hits = np.zeros((len(words), self.rows.shape[1])), np.zeros(len(words))
        for n, found, which, of in _grams(words, list(self.other)):
            rows = np.array([self.place.get(f"{n}{g}", self.other[n]) for g in found], int)
            for i, column in enumerate(self.rows.T):
                values[:, i] += np.bincount(of, column[rows][which], len(words))
            hits += np.bincount(of, (rows < len(self.place))[which], len(words))
        return values, hits


def _quoted(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each language (rows of ``values``), how much likelier a text in it gets at most if one run of its words is another's."""
    n = len(values)
    total, low, gain = np.zeros((n, 1)), np.zeros((n, n)), np.zeros(n)
    for at in range(0, len(words), PIECE):
        sums = total + values[:, words[at : at + PIECE]].cumsum(1)
        for own in range(n):
            ahead = sums - sums[own]
            least = np.minimum(np.minimum.accumulate(ahead, 1), low[own][:, None])
            gain[own], low[own] = max(gain[own], (ahead - least).max()), least[:, -1]
        total = sums[:, -1:]
    return gain


def detect(texts: DataFrame, model: LanguageModel, key: Sequence[str], *, text: str = "text", margin: float = MARGIN, quote: float | None = None) -> DataFrame:
    """(key, language, margin): the likeliest language of each key's texts, null without letters the model knows or where the
    next language is nearly as likely.

    n-grams that the model lacks count by their language's smoothing. Texts of one key count together; null texts are empty.
    With ``quote`` a passage in another language doesn't decide, however long it is: of a text one run of words may be taken as
    another language's, at the price ``quote`` (a logarithm), so that the language on both sides of it is the text's. Where that
    doesn't put a language ahead by as much, as for a text in two halves, the whole text decides as without it.
    """
    n = len(model.languages)
    prepare(texts.sparkSession)
    rows = texts.select(*key, words(F.col(text)).alias("_w"))
    shared = texts.sparkSession.sparkContext.broadcast(([tuple(r) for r in model.table.collect()], model.unseen))  # at most ``keep`` rows an order
    plain, hosted = [f"_s{i}" for i in range(n)], [f"_h{i}" for i in range(n)] if quote is not None else []

    def run(batches):
        held = _Values(*shared.value)
        for batch in batches:
            lists = batch.columns[-1]
            coded = lists.flatten().dictionary_encode()
            values, hits = held.of(coded.dictionary)
            items, sizes = coded.indices.to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            of = np.repeat(np.arange(len(lists)), sizes)
            summed = lambda x, of=of, lists=lists: np.bincount(of, x, len(lists)).astype(float)
            values = np.ascontiguousarray(values.T)
            sums = np.stack([summed(c[items]) for c in values])
            made = [*batch.columns[:-1], pa.array(summed(hits[items])), *map(pa.array, sums)]
            if hosted:
                gains = np.array([_quoted(w, values) for w in np.split(items, np.cumsum(sizes)[:-1])]).reshape(-1, n)
                made += map(pa.array, np.ascontiguousarray(sums + np.maximum(gains - quote, 0).T))
            yield pa.RecordBatch.from_arrays(made, names=[*key, "_known", *plain, *hosted])
            pa.default_memory_pool().release_unused()

    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_w").schema], *[f"{c} double" for c in ("_known", *plain, *hosted)]])
    sums = rows.mapInArrow(run, fields).groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("_known", *plain, *hosted)])

    def best(names: list[str]) -> tuple[Column, Column]:
        ranked = F.sort_array(F.array(*[F.struct(F.col(c).alias("s"), F.lit(-i).alias("i")) for i, c in enumerate(names)]), asc=False)
        return F.element_at(F.array(*[F.lit(k) for k in model.languages]), 1 - ranked[0]["i"]), ranked[0]["s"] - ranked[1]["s"] if n > 1 else F.lit(float("inf"))

    name, ahead = best(plain)
    if hosted:
        own, by = best(hosted)
        sure = by >= max(quote, margin)
        name, ahead = F.when(sure, own).otherwise(name), F.when(sure, by).otherwise(ahead)
    told = sums.select(*key, name.alias("_l"), F.when(F.col("_known") > 0, ahead).alias("margin"))
    return told.select(*key, F.when(F.col("margin") >= margin, F.col("_l")).alias("language"), "margin")


def match_rates(turns: DataFrame, model: LanguageModel, *, key: str, turn: str = "turn", text: str = "text", expected: str = "language") -> DataFrame:
    """(key, requested_language_match_rate, first_turn_match) of assistant turns (key, turn, text, expected); turns whose language
    can't be told don't match."""
    found = detect(turns, model, [key, turn], text=text).select(key, turn, F.col("language").alias("_found"))
    hit = F.coalesce(F.col("_found") == F.col(expected), F.lit(False))
    rows = turns.join(found, [key, turn]).select(key, turn, hit.alias("_hit"))
    return rows.groupBy(key).agg(F.avg(F.col("_hit").cast("double")).alias("requested_language_match_rate"), F.min_by("_hit", turn).cast("double").alias("first_turn_match"))
