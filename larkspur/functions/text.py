"""Measures of message text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marker phrases, thresholds and character sets that results depend on.
POLITE = "thank you|thanks|please|appreciate|sorry|no problem|of course|sure thing|happy to|glad to|certainly|absolutely"
FRUSTRATED = (
    "frustrated|annoyed|unacceptable|ridiculous|already told you|already said|this is taking|waste of time|terrible|awful|"
    "I already|you asked me this|can you just"
)
TRIVIAL_CHARS, HEADERS, LIST_ITEMS, CODE_LINES, MATTR_WINDOW = 3, 1, 5, 5, 50
ENDINGS = [".", "!", "?", "…", "。", "！", "？", "।"]
CLOSINGS = [")", "]", "}", "」", "』", '"', "'", "”", "’", "»"]
PAIRS = {"(": ")", "[": "]", "{": "}", "「": "」", "『": "』"}


def _blank_free(text: Column) -> Column:
    """Unicode white space at both ends removed."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def cjk_word_count(text: Column) -> Column:
    """Two Han, kana or Hangul characters make a word; the rest counts by white space."""
    cjk = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"
    rest = F.regexp_replace(text, cjk, " ")
    return (word_count(rest) + F.ceil(F.regexp_count(text, F.lit(cjk)) / 2)).cast("int")


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def front_loading(turns: Column) -> Column:
    """Words of the first turn over the mean of the later ones; null below two turns or for empty later turns."""
    counts = F.transform(turns, word_count)
    rest = _mean(F.slice(counts, 2, F.greatest(F.size(counts), F.lit(1))))
    return F.when((F.size(turns) >= 2) & (rest > 0), F.get(counts, 0) / rest)


def verbosity_cv(turns: Column) -> Column:
    """Population deviation of the turns' word counts over their mean."""
    counts = F.transform(turns, lambda t: word_count(t).cast("double"))
    mean = _mean(counts)
    spread = F.sqrt(_mean(F.transform(counts, lambda x: (x - mean) * (x - mean))))
    return F.when((F.size(turns) >= 2) & (mean > 0), spread / mean)


def marker_fraction(turns: Column, markers: str) -> Column:
    """Share of the turns in which one of the marker phrases stands as words."""
    hits = F.size(F.filter(turns, lambda t: t.rlike(rf"(?iu)\b({markers})\b")))
    return F.when(F.size(turns) > 0, hits / F.size(turns))


def mattr(tokens: Column, window: int = MATTR_WINDOW) -> Column:
    """Moving-average type-token ratio; the plain ratio below one window, 0 without tokens.

    A token counts in each window whose first token of its kind it is: those that
    begin after its previous occurrence. Sorted by token and place, previous
    occurrences are neighbours, so no window is gone through. Give ``tokens`` as a
    column, not as an expression that each use would compute anew.
    """
    n = F.size(tokens)
    placed = F.array_sort(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    before = F.concat(F.array(F.lit(None).cast("struct<t:string,i:int>")), placed)

    def windows(now, last):
        previous = F.when(last["t"] == now["t"], last["i"]).otherwise(-1)
        first = F.greatest(previous + 1, now["i"] - window + 1, F.lit(0))
        return F.greatest(F.least(now["i"], n - window) - first + 1, F.lit(0))

    counts = F.zip_with(placed, F.slice(before, 1, F.greatest(n, F.lit(1))), windows)
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, F.lit(0.0)).when(n < window, F.size(F.array_distinct(tokens)) / n).otherwise(total / (n - window + 1) / window)


def letter_share(text: Column, script: str) -> Column:
    """Share of a text's letters that belong to a Unicode script (Java name, as ``Latin``); null without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(rf"[\p{{L}}&&[\p{{Is{script}}}]]")) / letters)


def is_trivial(text: Column) -> Column:
    bare = _blank_free(F.coalesce(text, F.lit("")))
    return (F.length(bare) < TRIVIAL_CHARS) | ~bare.rlike(r"[\p{L}\p{N}]")


def is_over_formatted(text: Column) -> Column:
    count = lambda pattern: F.regexp_count(text, F.lit(r"(?m)" + pattern))
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```[^\n]*\n(.*?)```"), 1)
    long_code = F.exists(fences, lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))) + 1 > CODE_LINES)
    return (
        (count(r"^\s{0,3}#{1,6}\s+\S") > HEADERS)
        | (count(r"^\s{0,3}(?:-{3,}|\*{3,}|_{3,})\s*$") > 0)
        | (count(r"^\s*\|.+\|\s*$") > 0)
        | (count(r"^\s{0,3}\d+[.)]\s+\S") > LIST_ITEMS)
        | (count(r"^\s{0,3}[-*+]\s+\S") > LIST_ITEMS)
        | long_code
    )


def looks_truncated(text: Column) -> Column:
    """The text stops without an ending or closing character, or opens more brackets than it closes."""
    bare = F.regexp_replace(text, r"(?U)\s+$", "")
    times = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c)))
    open_left = reduce(lambda a, b: a | b, (times(o) > times(c) for o, c in PAIRS.items()))
    return (F.length(bare) > 0) & (~F.right(bare, F.lit(1)).isin(ENDINGS + CLOSINGS) | open_left)


def shape_rates(turns: Column) -> dict[str, Column]:
    """1 minus the share of flagged turns, for trivial, over-formatted and truncated ones; null without turns."""
    n = F.size(turns)
    rate = lambda flag: F.when(n > 0, 1 - F.size(F.filter(turns, flag)) / n)
    return {
        "shape.empty_or_trivial_rate": rate(is_trivial),
        "shape.over_formatted_rate": rate(lambda t: ~is_trivial(t) & is_over_formatted(t)),
        "shape.truncation_suspicion_rate": rate(lambda t: ~is_trivial(t) & looks_truncated(t)),
    }


#: Our own short refusal lexicon by language; pass another to ``refusal_rates``.
REFUSALS = {
    "en": ["i can't help with", "i cannot help with", "i'm unable to", "i am unable to", "i won't be able to", "as an ai"],
    "de": ["ich kann dabei nicht helfen", "das kann ich nicht", "als ki"],
    "fr": ["je ne peux pas vous aider", "je suis dans l'incapacité", "en tant qu'ia"],
    "es": ["no puedo ayudarte con", "no me es posible", "como ia"],
}
CANNED = ["i'm sorry, but i can't assist with that", "i cannot comply with this request"]


def phrase_pattern(phrases: list[str]) -> str:
    quoted = "|".join("\\Q" + p + "\\E" for p in sorted(phrases, key=lambda p: (-len(p), p)))
    return rf"(?iu)(?<!\p{{L}})(?:{quoted})(?!\p{{L}})"


def refusal_rates(turns: Column, language: Column, lexicon: dict[str, list[str]] | None = None, canned: list[str] = CANNED) -> dict[str, Column]:
    """Share of refusing turns (reported only), and 1 minus the shares refusing by a canned phrase or in another language."""
    lexicon = lexicon or REFUSALS
    n = F.size(turns)
    any_language = phrase_pattern([p for ps in lexicon.values() for p in ps] + canned)
    own = reduce(lambda acc, kv: acc.when(language == kv[0], F.lit(phrase_pattern(kv[1]))), lexicon.items(), F.when(F.lit(False), F.lit("")))
    refuses = lambda t: t.rlike(any_language)
    foreign = lambda t: refuses(t) & own.isNotNull() & ~F.coalesce(F.regexp_like(t, own), F.lit(False))
    rate = lambda flag: F.when(n > 0, F.size(F.filter(turns, flag)) / n)
    return {
        "refusal.detected_rate": rate(refuses),
        "refusal.canned_phrase_rate": 1 - rate(lambda t: t.rlike(phrase_pattern(canned))),
        "refusal.in_wrong_language_rate": 1 - rate(foreign),
    }
