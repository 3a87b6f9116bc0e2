"""Quality rules: simple counts, then compression bands.

zstandard's ratio (bytes by compressed bytes) is low for text without structure
(keys, encoded data, random characters) and high for text that repeats itself.
What is usual grows with a text's length, so each length has its own band. The
whole document must lie in its band, and so must its chunks of a fixed size: a
long document with a long repetitive or incompressible part can have a usual ratio
as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .shared import keyed_text

SYMBOLS = b"#*$%&|<>"
WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
LEVEL, CHUNK = 3, 4096
#: From so many bytes on, the least and the greatest usual ratio; shorter texts have no band, as the frame's few bytes decide.
BANDS = (
    (64, 0.80, 2.5),
    (256, 1.15, 3.0),
    (1024, 1.40, 3.5),
    (4096, 1.60, 4.0),
    (16_384, 1.70, 5.0),
    (65_536, 1.75, 6.0),
)
#: A document goes if chunks with more than this share of its bytes are outside their bands.
MAX_OUTSIDE = 0.5


def in_band(size: int, packed: int, bands=BANDS) -> bool:
    """Whether ``size`` bytes that compress to ``packed`` are as compressible as text of that size is."""
    for least, low, high in reversed(bands):
        if size >= least:
            return low <= size / packed <= high
    return True


def compression_verdict(data: bytes, compress, *, bands=BANDS, chunk: int = CHUNK, max_outside: float = MAX_OUTSIDE) -> bool:
    """Whether a text's bytes as a whole, and enough of its chunks, lie in their bands."""
    if not in_band(len(data), len(compress(data)), bands):
        return False
    if len(data) <= chunk:
        return True
    outside = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        outside += 0 if in_band(len(part), len(compress(part)), bands) else len(part)
    return outside <= max_outside * len(data)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a run of ``window`` words that the text has at least twice."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    names = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    # names of runs from those of two shorter ones that overlap or touch; equal names are equal runs
    have = 1
    while have < window:
        step = min(have, window - have)
        names = names[:-step] * (int(names.max()) + 1) + names[step:]
        have += step
        if have < window or n < 2:
            names = np.unique(names, return_inverse=True)[1]
    order = np.argsort(names, kind="stable")
    same = names[order][1:] == names[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    ends = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(ends, at, 1)
    np.add.at(ends, at + window, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; words are parted by ASCII white space."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    spaces = len(data) - sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, len(lines) - len(set(lines)), repeated_words(words)


def apply_rules(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK, max_outside: float = MAX_OUTSIDE, level: int = LEVEL
) -> DataFrame:
    """One row per input row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    and ratio (bytes by compressed bytes of the whole text; 0 for empty ones).

    base_failed: under 20 words, or over 30 % of them in 8-word runs that occur twice. Other documents are kept if
    their compression lies in the bands. Null texts are empty (no words, base_failed); null ids and repeated rows are kept
    as they are, every copy with the same verdict; other columns are ignored; an empty table gives an empty result.
    """
    source = keyed_text(docs, id_col, text_col)
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio"]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=level)
        pack = packer.compress
        for batch in batches:
            found, failed, kept, ratios = [], [], [], []
            for text in batch.column(1).to_pylist():
                c = counts(text)
                data = text.encode("utf-8", "surrogatepass")
                found.append(c)
                failed.append(c[0] < MIN_WORDS or 100 * c[4] > MAX_REPEATED * c[0])
                kept.append(not failed[-1] and compression_verdict(data, pack, bands=bands, chunk=chunk, max_outside=max_outside))
                ratios.append(len(data) / len(pack(data)) if data else 0.0)
            columns = np.array(found, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(ratios, pa.float64())], names=names)

    kind = source.schema["id"].dataType.simpleString()
    made = source.mapInArrow(run, f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double")
    return made.withColumnRenamed("id", id_col)
