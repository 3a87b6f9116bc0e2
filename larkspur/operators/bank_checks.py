"""Quality checks of a document bank: one flag a check and document, then counts by scope."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document types written for the agent, and what separates digit groups where the decimal is a comma.
AGENT_FACING = ("policy_procedure", "discoverable_tool_doc", "regulatory_note")
DECIMAL_COMMA_GROUPS = {"fr": [" ", " ", " "], "de": ["."], "pt": ["."]}
PLACEHOLDER = r"(?i)\[(?:insert|todo|tbd|your)[^\]]*\]|\{\{[^}]*\}\}|lorem ipsum|\bTODO\b|\bTBD\b"


def value_forms(value: float, locale: str = "en_US") -> list[str]:
    """How a document may write a number: plain, grouped, with decimals, in lakh and crore, in units of ten thousand."""
    whole = float(value).is_integer()
    groups = DECIMAL_COMMA_GROUPS.get(locale.split("_")[0])
    if groups:
        forms = {str(int(value))} if whole else set()
        for g in groups:
            if whole:
                forms.add(f"{int(value):,}".replace(",", g))
            if isinstance(value, float):
                forms |= {x.replace(",", "\0").replace(".", ",").replace("\0", g) for x in (f"{value}", f"{value:.2f}", f"{value:,.2f}")}
        return sorted(forms)
    forms = {str(value)}
    if isinstance(value, float):
        forms |= {f"{value:.2f}", f"{value:,.2f}"}
    if whole:
        n = int(value)
        head, tail = str(abs(n))[:-3], str(abs(n))[-3:]
        pairs = re.sub(r"(?<=\d)(?=(?:\d\d)+$)", ",", head)
        forms |= {str(n), f"{n:,}", ("-" if n < 0 else "") + (f"{pairs},{tail}" if head else tail)}
        for unit, size in (("lakh", 100_000), ("crore", 10_000_000)):
            if abs(n) >= size and (n * 100) % size == 0:
                q = f"{n / size:.2f}".rstrip("0").rstrip(".")
                forms |= {f"{q} {unit}", f"{q} {unit}s"}
        if n >= 10_000 and n % 10_000 == 0:
            high, low = divmod(n // 10_000, 10_000)
            for small, large in (("万", "億"), ("만", "억")):
                if not high:
                    forms |= {f"{low:,}{small}", f"{low}{small}"}
                elif not low:
                    forms |= {f"{high:,}{large}", f"{high}{large}"}
                else:
                    forms |= {f"{a}{large}{s}{b}{small}" for a in (f"{high:,}", str(high)) for b in (f"{low:,}", str(low)) for s in ("", " ")}
    return sorted(forms)


def states_value(text: Column, value: float, locale: str = "en_US") -> Column:
    """Whether a text states a number as a whole number of its own, not inside a longer one."""
    forms = "|".join("\\Q" + f + "\\E" for f in sorted(value_forms(value, locale), key=len, reverse=True))
    return text.rlike(rf"(?<![0-9])(?<![0-9][.,])(?:{forms})(?![0-9]|[.,][0-9])")


def english_decimals(text: Column, units: Sequence[str]) -> Column:
    """An amount or rate with a decimal point before one of the units."""
    unit = "|".join("\\Q" + u + "\\E" for u in units)
    return text.rlike(rf"(?<![\d.,])\d{{1,3}}(?:,\d{{3}})*\.\d{{1,2}}(?=\s?(?:{unit}))")


def names_in_text(text: Column, names: Sequence[str]) -> Column:
    """The snake-case names that stand in a text as tokens, each once."""
    tokens = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z0-9]+(?:_[A-Za-z0-9]+)+)\b"), 1)
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(n) for n in names])) if names else F.expr("array()").cast("array<string>"))


def document_checks(
    docs: DataFrame, *, field_names: Sequence[str] = (), tool_names: Sequence[str] = (), units: Sequence[str] = ("%", "€"), locale: str = "en_US", script: str = "Latin", min_chars: int = 1
) -> DataFrame:
    """(scope, document, check, failed) for documents (scope, document, document_type, title, body)."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")))
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    checks = {
        "empty": F.length(F.trim("body")) < min_chars,
        "placeholder": text.rlike(PLACEHOLDER),
        "variable_name_leak": F.size(names_in_text(text, [n for n in field_names if "_" in n])) > 0,
        "tool_name_leak": ~F.col("document_type").isin(*AGENT_FACING) & (F.size(names_in_text(text, [n for n in tool_names if "_" in n])) > 0),
        "number_notation": english_decimals(F.col("body"), units) if locale.split("_")[0] in DECIMAL_COMMA_GROUPS else F.lit(False),
        "script": (letters > 0) & (F.regexp_count(text, F.lit(rf"[\p{{L}}&&[\p{{Is{script}}}]]")) / letters < 0.5),
    }
    rows = docs.select("scope", "document", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    return rows.unpivot(["scope", "document"], list(checks), "check", "failed")


def check_report(found: DataFrame, examples: int = 3) -> DataFrame:
    """(check, scope, n, n_failed, level, examples): failures by check and scope, with the first ids."""
    ids = F.slice(F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("document")))), 1, examples)
    out = found.groupBy("check", "scope").agg(F.count("*").alias("n"), F.count_if("failed").alias("n_failed"), ids.alias("examples"))
    soft = F.col("check").isin("variable_name_leak", "tool_name_leak", "script")
    return out.withColumn("level", F.when(F.col("n_failed") == 0, "pass").when(soft, "warn").otherwise("fail"))


def repeated_document_ids(docs: DataFrame) -> DataFrame:
    return docs.groupBy("scope", "document").agg(F.count("*").alias("n")).where("n > 1")


def coverage_gaps(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, document_type) that are wanted but that no document has."""
    return wanted.join(docs.select("scope", "document_type").distinct(), ["scope", "document_type"], "left_anti")
