"""Locales: resolution, scripts, and how they write money, percentages and large numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Locale:
    code: str
    language: str
    label: str
    script: str
    group: str = ","
    decimal: str = "."
    symbol: str = "$"
    symbol_last: bool = False
    indian: bool = False


# The locales' own notation.
LOCALES = {
    l.code: l
    for l in (
        Locale("en_US", "en", "English", "Latin"),
        Locale("en_GB", "en", "English", "Latin", symbol="£"),
        Locale("en_IN", "en", "English", "Latin", symbol="₹", indian=True),
        Locale("hi_Deva_IN", "hi", "Hindi", "Devanagari", symbol="₹", indian=True),
        Locale("de_DE", "de", "German", "Latin", group=".", decimal=",", symbol="€", symbol_last=True),
        Locale("fr_FR", "fr", "French", "Latin", group=" ", decimal=",", symbol="€", symbol_last=True),
        Locale("es_ES", "es", "Spanish", "Latin", group=".", decimal=",", symbol="€", symbol_last=True),
        Locale("pt_BR", "pt", "Portuguese", "Latin", group=".", decimal=",", symbol="R$"),
        Locale("ja_JP", "ja", "Japanese", "Hiragana", symbol="¥"),
        Locale("ko_KR", "ko", "Korean", "Hangul", symbol="₩"),
    )
}
DEFAULT = "en_US"


def resolve(code: str | None, available: list[str] | None = None) -> str:
    """An exact code, else the first with its language, else the default."""
    known = available or list(LOCALES)
    if code in known:
        return code
    language = (code or "").split("_")[0]
    return next((k for k in known if k.split("_")[0] == language), DEFAULT)


def grouped(value: Column, locale: str) -> Column:
    """A whole number with the locale's grouping; Indian locales group by two after the first three digits."""
    l = LOCALES[resolve(locale)]
    digits = F.abs(value).cast("decimal(38,0)").cast("string")
    if l.indian:
        head, tail = F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 3, F.lit(0))), F.right(digits, F.lit(3))
        head = F.reverse(F.regexp_replace(F.reverse(head), r"(\d{2})(?=\d)", f"$1{l.group}"))
        text = F.when(F.length(digits) > 3, F.concat(head, F.lit(l.group), tail)).otherwise(digits)
    else:
        text = F.reverse(F.regexp_replace(F.reverse(digits), r"(\d{3})(?=\d)", f"$1{l.group}"))
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def number(value: Column, locale: str, places: int = 2) -> Column:
    l = LOCALES[resolve(locale)]
    scaled = F.round(F.abs(value) * 10**places).cast("decimal(38,0)")
    unit = 10**places
    whole = grouped(F.floor(scaled / unit), locale)
    part = F.lpad((scaled % unit).cast("decimal(38,0)").cast("string"), places, "0")
    return F.concat(F.when(value < 0, "-").otherwise(""), whole, F.lit(l.decimal), part) if places else F.concat(F.when(value < 0, "-").otherwise(""), whole)


def money(value: Column, locale: str, places: int = 2) -> Column:
    l = LOCALES[resolve(locale)]
    text = number(F.abs(value), locale, places)
    shown = F.concat(text, F.lit(" " + l.symbol)) if l.symbol_last else F.concat(F.lit(l.symbol), text)
    return F.concat(F.when(value < 0, "-").otherwise(""), shown)


def percent(value: Column, locale: str, places: int = 1) -> Column:
    l = LOCALES[resolve(locale)]
    return F.concat(number(value, locale, places), F.lit(" %" if l.symbol_last else "%"))


def localized(texts: Column, locale: Column, default: str = DEFAULT) -> Column:
    """A map's text for a locale, else for the default."""
    return F.coalesce(F.element_at(texts, locale), F.element_at(texts, default))
