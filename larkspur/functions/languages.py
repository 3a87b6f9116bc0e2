"""Language and script of texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Frequent function words by language, and the scripts that are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as this be at by from or an have not",
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass",
    "fr": "de la le et les des en un du une que est pour qui dans par au il sur pas plus ne ce avec sont",
    "es": "de la que el en y los se del las un por con una su para es al lo como más pero sus le",
    "pt": "de que não do da em um para com uma os no se na por mais as dos como mas foi ao ele das tem",
    "it": "di che e la il un a per è in una sono non si con come da anche ma le dei nel alla più",
}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Arabic", "Hebrew", "Thai", "Han", "Hiragana", "Katakana", "Hangul")
SCRIPT_LANGUAGES = {"Cyrillic": "ru", "Greek": "el", "Devanagari": "hi", "Bengali": "bn", "Tamil": "ta", "Telugu": "te", "Kannada": "kn", "Arabic": "ar", "Hebrew": "he", "Thai": "th", "Hiragana": "ja", "Katakana": "ja", "Hangul": "ko", "Han": "zh"}
MIN_FOREIGN_LETTERS = 2


# Characters of no script but Latin: below U+0370, Latin Extended Additional, general punctuation.
_NOT_OTHER = r"[\x{0}-\x{36F}\x{1E00}-\x{1EFF}\x{2000}-\x{206F}]+"


def _count(text: Column, script: str) -> Column:
    """Letters of a script: what is left when runs of all else are taken out, so that no match becomes a value of its own."""
    if script == "Latin":
        return F.length(F.regexp_replace(text, r"[^a-zA-Z[\p{L}&&[\p{IsLatin}]]]+", ""))
    return F.length(F.regexp_replace(F.regexp_replace(text, _NOT_OTHER, ""), rf"[^[\p{{L}}&&[\p{{Is{script}}}]]]+", ""))


def script_counts(text: Column) -> Column:
    """A map of the scripts that a text's letters belong to, with their numbers."""
    pairs = F.array(*[F.struct(F.lit(s).alias("key"), _count(text, s).alias("value")) for s in SCRIPTS])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"] > 0))


def _first_script(text: Column) -> Column:
    """The script ``s`` of most letters (by name where equal) and its language ``l``, null for Latin; without letters ``s`` is null, ``l`` empty.

    No lambda: what the counts share (the text without Latin) is computed once.
    """
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("s"), F.lit("").alias("l"))
    counted = [F.struct((-F.coalesce(_count(text, s), F.lit(0))).alias("n"), F.lit(s).alias("s"), F.lit(SCRIPT_LANGUAGES.get(s)).cast("string").alias("l")) for s in SCRIPTS]
    return F.array_min(F.array(none, *counted))


def dominant_script(text: Column) -> Column:
    """The script of most letters (by name where equal); null without letters."""
    return _first_script(text)["s"]


def foreign_scripts(text: Column, expected: Column) -> Column:
    """Scripts outside the expected ones (array) with at least two letters, sorted; Latin is never foreign."""
    entries = F.filter(F.map_entries(script_counts(text)), lambda e: (e["value"] >= MIN_FOREIGN_LETTERS) & (e["key"] != "Latin") & ~F.array_contains(expected, e["key"]))
    return F.array_sort(F.transform(entries, lambda e: e["key"]))


def detect_language(text: Column, words: Mapping[str, str] = FUNCTION_WORDS) -> Column:
    """A language code: by script where that tells it, else the language with most function words in the text; null if none has any.

    A plain stand-in for a trained detector; pass a column of your own detector's
    results where you have one.
    """
    own = {lang: words[lang].split() for lang in words}
    known = sorted({w for ws in own.values() for w in ws})
    hits = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t.isin(*known))  # split once, whatever the number of languages

    def by_words(held: Column) -> Column:
        score = lambda lang: F.struct((-F.size(F.filter(held, lambda t: t.isin(*own[lang])))).alias("n"), F.lit(lang).alias("l"))
        none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("l"))
        return F.array_min(F.array(none, *[score(lang) for lang in own]))["l"]

    told = F.transform(F.array(hits), by_words)[0]
    return F.nullif(F.coalesce(_first_script(text)["l"], told), F.lit(""))


def language_match_rates(turns: Column, expected: Column, detect=detect_language) -> dict[str, Column]:
    """Share of turns in the expected language, and whether the first one is; null without turns."""
    hit = lambda t: F.coalesce(detect(t) == expected, F.lit(False))
    n = F.size(turns)
    return {
        "language.requested_language_match_rate": F.when(n > 0, F.size(F.filter(turns, hit)) / n),
        "language.first_turn_match": F.when(n > 0, hit(F.get(turns, 0)).cast("double")),
    }


def user_script_compliance(text: Column, script: str, min_letters: int = 4) -> Column:
    """Share of letters in a script after ASCII codes with digits (as ``AB12``) are left out; null below ``min_letters`` letters."""
    bare = F.regexp_replace(text, r"\b(?=[A-Za-z0-9-]*[0-9])[A-Za-z0-9-]+\b", " ")
    letters = F.regexp_count(bare, F.lit(r"\p{L}"))
    return F.when(letters >= min_letters, _count(bare, script) / letters)
