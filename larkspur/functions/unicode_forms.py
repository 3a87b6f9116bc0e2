"""Unicode forms that Spark has no expression for, made once for each distinct text and only where one isn't ASCII."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

_INVISIBLE = dict.fromkeys([*range(0x200B, 0x2010), 0x2060, 0xFEFF, 0xAD])


def fold_name(text: str) -> str:
    """A name as it's compared: NFKC, no invisible characters, case-folded, runs of white space as one space."""
    return " ".join(unicodedata.normalize("NFKC", text).translate(_INVISIBLE).casefold().split())


def fold_token(text: str) -> str:
    """A search token: half-width katakana and full-width forms as usual ones, NFC, case-folded."""
    return unicodedata.normalize("NFC", "".join(unicodedata.normalize("NFKC", c) if "＀" <= c <= "￯" else c for c in unicodedata.normalize("NFC", text)).casefold())


FORMS = {"name": fold_name, "token": fold_token}


def with_form(df: DataFrame, column: str, form: str, out: str) -> DataFrame:
    """``df`` with ``out``: the form (``name`` or ``token``) of the text in ``column``; null of null.

    ASCII texts are done by expressions; each distinct other text is sent to Python once and joined back.
    """
    ship(df.sparkSession)
    plain = F.lower(F.col(column))
    if form == "name":
        plain = F.trim(F.regexp_replace(plain, r"[\s\x1c-\x1f]+", " "))
    other = df.where(F.col(column).rlike(r"[^\x00-\x7f]")).select(F.col(column).alias("_form_of")).distinct()

    def run(batches):
        fold = FORMS[form]
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(t) for t in batch.column(0).to_pylist()], pa.string())], names=["_form_of", "_form"])

    made = other.mapInArrow(run, "_form_of string, _form string")
    return df.join(made, F.col(column) == F.col("_form_of"), "left").withColumn(out, F.coalesce("_form", plain)).drop("_form_of", "_form")
