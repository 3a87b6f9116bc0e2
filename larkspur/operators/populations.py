"""Who a run samples from: a panel's locales, and the personas that speak a conversation's language."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.locales import LOCALES


@dataclass(frozen=True)
class Corpus:
    """How a persona corpus tells its people's language: the column, and names that it spells in its own way."""

    column: str
    spelled: Mapping[str, str] = field(default_factory=dict)


# The corpora that have a language column, and their own names of languages.
CORPORA = {
    "en_IN": Corpus("first_language"),
    "hi_Latn_IN": Corpus("first_language", {"English": "Angrezi"}),
    "hi_Deva_IN": Corpus(
        "first_language",
        {
            "Bengali": "बंगाली", "English": "अंग्रेज़ी", "Gujarati": "गुजराती", "Hindi": "हिंदी", "Kannada": "कन्नडा", "Malayalam": "मलयालम", "Marathi": "मराठी",
            "Nepali": "नेपाली", "Odia": "ओडिया", "Punjabi": "पंजाबी", "Tamil": "तमिल", "Telugu": "तेलुगू", "Urdu": "उर्दू",
        },
    ),
}


def language_name(label: str | None) -> str | None:
    """The language of a locale's label: ``Indian English`` is English, ``Hindi Devanagari`` Hindi; None of a blank one."""
    words = (label or "").split()
    return None if not words else "English" if words[-1] == "English" else words[0]


def language_filter(conversation: str, corpus: str, *, labels: Mapping[str, str] | None = None, corpora: Mapping[str, Corpus] = CORPORA) -> tuple[str, str] | None:
    """(column, value) that a corpus' people must have to speak a conversation locale's language; None where the corpus has no
    language column or the locale no label."""
    name = language_name((labels or {k: l.label for k, l in LOCALES.items()}).get(conversation))
    held = corpora.get(corpus)
    return None if held is None or name is None else (held.column, held.spelled.get(name, name))


def matching_personas(personas: DataFrame, conversation: str, corpus: str, **tables) -> DataFrame:
    """The people of a corpus who speak the conversation's language; all of them where nothing tells it."""
    wanted = language_filter(conversation, corpus, **tables)
    return personas if wanted is None else personas.where(F.col(wanted[0]) == wanted[1])


def language_populations(personas: DataFrame, conversations: Sequence[str], corpus: str, **tables) -> DataFrame:
    """(conversation_locale, language_column, language, eligible_rows, total_rows, eligible_percent), all locales in one scan.

    Locales that the corpus can't be narrowed for have no row; a corpus without rows has percentages of 0.
    """
    spark = personas.sparkSession
    wanted = [(c, *f) for c in dict.fromkeys(conversations) if (f := language_filter(c, corpus, **tables))]
    named = spark.createDataFrame(wanted, "conversation_locale string, language_column string, language string")
    if not wanted:
        return named.selectExpr("*", "0L AS eligible_rows", "0L AS total_rows", "0.0D AS eligible_percent")
    column = wanted[0][1]  # a corpus has one
    counted = personas.groupBy(F.col(column).cast("string").alias("_value")).agg(F.count("*").alias("_n"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"))
    joined = named.join(counted, named["language"] == counted["_value"], "left").crossJoin(F.broadcast(total))  # one row
    n = F.coalesce("_n", F.lit(0))
    percent = F.when(F.col("total_rows") > 0, 100.0 * n / F.col("total_rows")).otherwise(0.0)
    return joined.select("conversation_locale", "language_column", "language", n.alias("eligible_rows"), "total_rows", percent.alias("eligible_percent"))


def panel_locales(panel: DataFrame) -> DataFrame:
    """(locale, n_rows) of a panel, without rows that have no locale."""
    return panel.where(F.col("locale").isNotNull()).groupBy("locale").agg(F.count("*").alias("n_rows"))


# --- what a conversation shows, by the model that wrote it ---------------------------------------------

#: Roles in messages by the alias of the model that writes them.
ALIAS_ROLES = {"assistant_model": "assistant", "user_model": "user", "api_response_model": "tool"}


def visible_text(messages: Column, alias: str) -> Column:
    """What an alias wrote in a conversation (JSON list), a message a line: contents, and for the assistant each message's tool
    calls as compact JSON after it. Null where the messages can't be read."""
    role = ALIAS_ROLES[alias]
    parsed = F.from_json(F.when(F.trim(messages).startswith("["), messages), "array<struct<role:string,content:string,tool_calls:string>>")
    own = F.filter(parsed, lambda m: m["role"] == role)
    empty = lambda t: t.isNull() | t.isin("", "[]", "null")
    parts = lambda m: F.array(F.coalesce(m["content"], F.lit("")), m["tool_calls"]) if role == "assistant" else F.array(F.coalesce(m["content"], F.lit("")))
    kept = F.transform(own, lambda m: F.when(empty(m["tool_calls"]), F.slice(parts(m), 1, 1)).otherwise(parts(m)))
    return F.array_join(F.flatten(kept), "\n")


def visible_tokens(rows: DataFrame, *, messages: str = "conversation_messages", count=None) -> DataFrame:
    """(alias, n_rows, n_unreadable, visible_tokens): tokens shown by each alias; ``count`` counts a text column's tokens, by
    default four thirds of its words, rounded up."""
    words = lambda t: F.ceil(F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")) * 4 / 3)
    count = count or words
    texts = F.array(*[F.struct(F.lit(a).alias("alias"), visible_text(F.col(messages), a).alias("text")) for a in ALIAS_ROLES])
    long = rows.select(F.explode(texts).alias("t")).select("t.alias", "t.text")
    return long.groupBy("alias").agg(F.count("*").alias("n_rows"), F.count_if(F.col("text").isNull()).alias("n_unreadable"), F.coalesce(F.sum(count(F.col("text"))), F.lit(0)).cast("long").alias("visible_tokens"))
