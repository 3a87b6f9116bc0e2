"""Cuts a text into the pre-tokens of a ``tokenizers`` file, as that library does.

The fast path uses the ``regex`` package; texts with characters from blocks that
Unicode still extends take the library's own normaliser and pre-tokeniser, as
the two may know different Unicode versions.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex
from tokenizers import Tokenizer

# The byte-level split pattern of the tokenizers library.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Anything outside blocks whose assignments have long been complete.
UNSETTLED = re.compile(
    "[^\x00-ɏΑ-ΡΣ-ωЀ-҂Ҋ-ӿ‐-‧‰-⁞"
    "€←-⋿　-〩ぁ-ゖァ-ヺ一-龥가-힣]"
)
SPACES = regex.compile(r"\s+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


BYTE_CHARS = byte_alphabet()
LATIN = {b: c for b, c in enumerate(BYTE_CHARS)}


def to_byte_chars(s: str) -> str:
    return s.encode("utf-8").decode("latin-1").translate(LATIN)


class Pretokenizer:
    """``parts(text)`` yields (special id, None) or (None, list of pre-tokens) in order.

    Pre-tokens are raw strings on the fast path; ``spelled`` tells whether they
    are already written in the byte alphabet.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with lstrip, rstrip, single_word or normalized are not supported")
        self.special_split = re.compile("(" + "|".join(re.escape(t) for t in self.specials) + ")") if self.specials else None
        self.normalizes = spec["normalizer"] is not None
        pre = spec["pre_tokenizer"]
        if pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not self.normalizes:
            self.pattern = regex.compile(BYTE_LEVEL_PATTERN)
        elif pre["type"] == "Sequence" and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]:
            self.pattern = regex.compile(pre["pretokenizers"][0]["pattern"]["Regex"])
        else:
            raise ValueError(f"{path}: only byte-level and lower-casing word tokenizers are supported")

    def parts(self, text: str):
        if self.special_split is not None and "<" in text:
            for k, piece in enumerate(self.special_split.split(text)):
                if k % 2:
                    yield self.specials[piece], None, False
                elif piece:
                    yield None, *self._cut(piece)
        elif text:
            yield None, *self._cut(text)

    def _cut(self, text: str) -> tuple[list[str], bool]:
        if UNSETTLED.search(text):
            if self.normalizes:
                text = self.tokenizer.normalizer.normalize_str(text)
            return [p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)], True
        if self.normalizes:
            text = SPACES.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        return self.pattern.findall(text), False
