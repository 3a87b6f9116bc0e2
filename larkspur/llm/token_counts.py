"""Token counts per document without token ids.

1. Each task reduces its texts to distinct pre-tokens and how often they occur;
   together they are the corpus' distinct pre-tokens.
2. Each distinct pre-token is counted once.
3. A second pass reduces every document to its pre-token frequencies and joins
   them to the counts: those of the most frequent pre-tokens, a table of bounded
   size, in the task, and the few others by shuffle. The products are summed.
"""

from __future__ import annotations

import uuid
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import BYTE_CHARS, Pretokenizer, to_byte_chars
from .shared import keep_table, keyed_text

#: Distinct pre-tokens that a task holds before it passes them on.
TABLE_ROWS = 400_000
#: The counts of so many pre-tokens of up to so many characters are sent to every task (at most 64 MB of text).
COMMON_ROWS, COMMON_CHARS = 250_000, 64
_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


class PieceTable:
    """A tokenizer's pre-tokens of a text, and the tokens of one pre-token."""

    def __init__(self, path: str):
        self.pre = Pretokenizer(path)
        self.model = self.pre.tokenizer.model

    def count(self, piece: str) -> int:
        return len(self.model.tokenize(to_byte_chars(piece)))

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """The number of special strings in a text, and its pre-tokens with their frequencies."""
        specials, pieces = 0, Counter()
        for special, found, spelled in self.pre.parts(text):
            if special is not None:
                specials += 1
            elif spelled:  # written in the byte alphabet
                pieces.update(bytes(map(_BYTES.__getitem__, p)).decode("utf-8") for p in found)
            else:
                pieces.update(found)
        return specials, pieces

    def tokens_of(self, text: str) -> int:
        specials, pieces = self.frequencies(text)
        return specials + sum(self.count(p) * times for p, times in pieces.items())


@lru_cache(maxsize=4)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def piece_counts(source: DataFrame, tokenizer_path: str) -> DataFrame:
    """(piece, times, n): the distinct pre-tokens of the column ``text``, how often they occur, and their numbers of tokens."""

    def distinct(batches):
        table, held = piece_table(tokenizer_path), Counter()

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["piece", "times"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(table.frequencies(text)[1])
                if len(held) >= TABLE_ROWS:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def count(batches):
        table = piece_table(tokenizer_path)
        for batch in batches:
            n = pa.array([table.count(p) for p in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], names=["piece", "times", "n"])

    pieces = source.select("text").mapInArrow(distinct, "piece string, times long").groupBy("piece").agg(F.sum("times").alias("times"))
    return keep_table(pieces.mapInArrow(count, "piece string, times long, n long"), "piece-counts")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, common_rows: int = COMMON_ROWS
) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    Null texts count as empty (0 bytes, 0 tokens), null ids and repeated rows
    are kept as they are, other columns are ignored, and an empty table gives an
    empty result. Special strings inside a text are one token each.
    """
    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["id"].dataType.simpleString()
    counts = piece_counts(source, tokenizer_path)
    often = counts.where(F.length("piece") <= COMMON_CHARS).orderBy(F.desc("times"), "piece").limit(common_rows).select("piece", "n").toArrow()
    whole = often.num_rows == counts.count()
    common = docs.sparkSession.sparkContext.broadcast(dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True)))

    def run(batches):
        table, known, task, at = piece_table(tokenizer_path), common.value, uuid.uuid4().hex, 0
        for batch in batches:
            sizes, sums, rests = [], [], []
            for text in batch.column(1).to_pylist():
                total, pieces = table.frequencies(text)
                rest = []
                for piece, times in pieces.items():
                    n = known.get(piece)
                    if n is None:
                        rest.append({"piece": piece, "times": times})
                    else:
                        total += n * times
                sizes.append(len(text.encode("utf-8")))
                sums.append(total)
                rests.append(rest)
            names = pa.array([f"{task}-{k}" for k in range(at, at + len(sizes))], pa.string())
            at += len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), names, pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(rests, pa.list_(pa.struct([("piece", pa.string()), ("times", pa.int64())])))],
                names=["id", "row", "n_bytes", "sum", "rest"],
            )

    rows = source.mapInArrow(run, f"id {kind}, row string, n_bytes long, sum long, rest array<struct<piece:string,times:long>>")
    if whole:
        rows = rows.select("id", "n_bytes", F.col("sum").alias("n_tokens"))
    else:
        rows = keep_table(rows, "token-sums")  # the rows' names differ from run to run
        rest = rows.select("row", F.explode("rest").alias("r")).select("row", "r.*").join(counts.select("piece", "n"), "piece")
        rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"))
        rows = rows.drop("rest").join(rest, "row", "left").select("id", "n_bytes", (F.col("sum") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return rows.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
