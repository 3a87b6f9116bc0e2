"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token there is exactly one token that can end its
encoding. An automaton over the vocabulary yields, for each end position, the
tokens that are suffixes of the prefix; the one that is compatible with the
unique last token of the shorter prefix is stored; back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import Pretokenizer, to_byte_chars
from .shared import keyed_text

#: Distinct pre-tokens whose encoding one worker keeps.
TABLE_ROWS = 150_000
LONG_PIECE = 64
#: Documents whose ids are held at a time.
STEP_ROWS = 100
#: One character that stands for the end-of-word suffix while tokens are matched.
END = "\n"


class PrefixEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.pre = Pretokenizer(path)
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.named = {str(i): t for table in (self.vocab, self.pre.specials) for t, i in table.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = self.vocab
        #: (left, right) -> (rank, merged); split: token -> its last merge.
        self.merged: dict[tuple[int, int], tuple[int, int]] = {}
        self.split: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            whole = ids.get(a + b)
            if a in ids and b in ids and whole is not None:
                self.merged.setdefault((ids[a], ids[b]), (rank, whole))
                self.split.setdefault(whole, (rank, ids[a], ids[b]))
        self.auto = ahocorasick.Automaton()
        for token, i in ids.items():
            flat = self._flat(token)
            if flat and (i in self.split or len(flat) - flat.endswith(END) == 1):
                self.auto.add_word(flat, (len(flat), i))
        self.auto.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        #: Pre-token -> ids; the older half is dropped when the younger is full.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}

    def _flat(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix):
            return token[: -len(self.suffix)] + END
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` stay two tokens when their strings are encoded together.

        They do unless, somewhere along the facing edges of the two merge trees,
        a merge across the border comes before the merges that hid that edge.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= 400_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        merged, split = self.merged, self.split
        limit = float("inf")  # when the merge ran that took away what now stands at the border
        while True:
            across = merged.get((left, right))
            if across is not None and across[0] < limit:
                return False
            l_rank, _, l_inner = split.get(left, (-1, 0, 0))
            r_rank, r_inner, _ = split.get(right, (-1, 0, 0))
            if l_rank < 0 and r_rank < 0:
                return True
            # Undo the later of the two merges. Merges of one rank run from left to
            # right: the border comes after the left token's and before the right one's.
            if l_rank > r_rank:
                limit, left = l_rank, l_inner
            else:
                limit, right = r_rank + 0.5, r_inner

    def ids_of(self, piece: str) -> list[int]:
        """``piece`` is spelled in the byte alphabet, without the end-of-word suffix."""
        text = piece + END if self.suffix else piece
        n = len(text)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        for end, (length, token) in self.auto.iter(text):
            end += 1
            if last[end] is None:
                start = end - length
                if start == 0 or (last[start] is not None and self.compatible(last[start][1], token)):
                    last[end] = (start, token)
        out, at = [], n
        while at:
            at, token = last[at]
            out.append(token)
        return out[::-1]

    def word(self, piece: str, spelled: bool) -> str:
        return " ".join(map(str, self.ids_of(piece if spelled else to_byte_chars(piece))))

    def encode(self, text: str) -> str:
        """The ids, joined by one space."""
        ids, words, older = [], self.words, self.older
        for special, pieces, spelled in self.pre.parts(text):
            if special is not None:
                ids.append(str(special))
            elif spelled:
                ids += [self.word(piece, True) for piece in pieces]
            else:
                for piece in pieces:
                    made = words.get(piece)
                    if made is None:
                        made = older.get(piece) or self.word(piece, False)
                        if len(piece) <= LONG_PIECE:
                            words[piece] = made
                    ids.append(made)
                if len(words) >= TABLE_ROWS:
                    self.older, self.words = words, {}
                    words, older = self.words, self.older
        return " ".join(ids)

    def decode(self, ids: str) -> str:
        """What the library decodes without a decoder: the token strings, joined by one space."""
        return " ".join(map(self.named.__getitem__, ids.split(" "))) if ids else ""


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_tokens, ids_sha256, decoded_sha256.

    With ``with_ids`` the ids (array<int>) follow. Null
    texts count as empty (no ids); null ids and repeated rows are kept; other
    columns are ignored; an empty table gives an empty result.
    """
    source = keyed_text(docs, id_col, text_col)
    digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def run(batches):
        encoder = prefix_encoder(tokenizer_path)
        for whole in batches:
            for at in range(0, whole.num_rows, STEP_ROWS):
                batch = whole.slice(at, STEP_ROWS)
                ids = [encoder.encode(t) for t in batch.column(1).to_pylist()]
                decoded = [encoder.decode(i) for i in ids]
                columns = [
                    batch.column(0),
                    pa.array([i.count(" ") + 1 if i else 0 for i in ids], pa.int64()),
                    pa.array([digest(i) for i in ids], pa.string()),
                    pa.array([digest(d) for d in decoded], pa.string()),
                ]
                names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.array(i.split(), np.int32) for i in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"id {source.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return source.mapInArrow(run, schema + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)
