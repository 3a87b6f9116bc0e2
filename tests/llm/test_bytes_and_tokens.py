"""op1, op2, op6 against brute force and the libraries."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm import repeats
from larkspur.llm.bpe import encode_documents, prefix_encoder
from larkspur.llm.repeats import remove_repeats
from larkspur.llm.token_counts import count_tokens, piece_table

SCHEMA = "text string, doc_id bigint, id string, n_tokens int"


def frame(spark, rows):
    return spark.createDataFrame([(t, i, "clash", 7) for i, t in rows], SCHEMA)


def brute_repeats(rows, window=repeats.WINDOW):
    first, out = {}, []
    key = lambda i: i if i is not None else float("inf")
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            first[w] = min(first.get(w, float("inf")), key(i))
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < key(i):
                gone[p : p + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["ab", "the", "é", "x" * 9, "du", "\n", "ing", "漢字"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared = [text(30), "a" * 120, "du " * 60, text(40)]
    rows = []
    for i in range(n):
        parts = [rnd.choice([text(rnd.randint(0, 40)), rnd.choice(shared), rnd.choice(shared)[rnd.randint(0, 40) :]]) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3, rnd.choice(["", " ", "\n"]).join(parts)))
    rows += [(1, rows[5][1]), (2, rows[5][1]), (2, rows[5][1]), (4, None), (5, ""), (None, rows[5][1]), (None, "z" * 60), (None, "z" * 60), (7, "q" * 49)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repeats(spark, seed):
    rows = corpus(seed)
    got = remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_repeats_in_small_chunks(spark, monkeypatch):
    rows = corpus(9)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 3000)
    got = remove_repeats(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_repeats(rows)


def test_repeats_of_nothing(spark):
    assert remove_repeats(frame(spark, [])).collect() == []


def test_kept_text(spark):
    rows = [(1, "x" * 60), (2, "head" + "x" * 60 + "tail")]
    got = {r.doc_id: r.kept for r in remove_repeats(frame(spark, rows), with_text=True).collect()}
    assert got == {1: b"x" * 60, 2: b"headtail"}


def test_repeat_groups_are_maximal():
    """Common-prefix intervals of a small text against all repeats found by comparing strings."""
    import numpy as np

    text = "abcabcabdxabcabd"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        n = 0
        while a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        lcp.append(n)
    left = np.array([-1, *map(ord, text[:-1])])
    got = {(n, frozenset(order[b:e])) for b, e, n in zip(*(x.tolist() for x in repeats.repeat_groups(np.array(order), np.array(lcp), left, 2)))}
    want = set()
    for n in range(2, len(text)):
        for s in {text[i : i + n] for i in range(len(text) - n + 1)}:
            at = [i for i in range(len(text)) if text.startswith(s, i)]
            lefts, rights = {text[i - 1] if i else i for i in at}, {text[i + n : i + n + 1] or -i for i in at}
            if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.add((n, frozenset(at)))
    assert got == want


def texts(seed, n):
    rnd = random.Random(seed)
    alphabet = ["a", "n", "l", "e", "the", "ing", " ", "  ", "\n", "é", "Σ", "İ", "ﬁ", "1", "23", "!", "'s", "…", "漢", "👍", "͸", "\x85", "​", "<|endoftext|>", "<|startoftext|>", "é", "\U00010940"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)] + ["", " ", "x" * 5000, "a b " * 3000]


@pytest.fixture(scope="module")
def word():
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def byte():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, Tokenizer.from_file(path)


def test_ids_equal_the_library(word):
    encoder = prefix_encoder(word[0])
    for t in texts(4, 4000):
        want = word[1].encode(t, add_special_tokens=False).ids
        assert encoder.encode(t) == " ".join(map(str, want)), repr(t)
        assert encoder.decode(encoder.encode(t)) == word[1].decode(want, skip_special_tokens=False)


def test_counts_equal_the_library(byte):
    table = piece_table(byte[0])
    for t in texts(5, 4000):
        assert table.tokens_of(t) == len(byte[1].encode(t, add_special_tokens=False).ids), repr(t)


def test_encode_documents(spark, word):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (3, ""), (None, "x")]
    got = sorted((tuple(r) for r in encode_documents(frame(spark, rows), word[0], with_ids=True).collect()), key=str)
    want = []
    for i, t in rows:
        ids = word[1].encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(word[1].decode(ids, skip_special_tokens=False)), ids))
    assert got == sorted(want, key=str)
    assert encode_documents(frame(spark, []), word[0]).collect() == []


def test_count_documents(spark, byte):
    rows = [(1, "é b"), (1, "é b"), (2, None), (None, "word " * 600)]
    got = sorted((tuple(r) for r in count_tokens(frame(spark, rows), byte[0]).collect()), key=str)
    n = lambda t: len(byte[1].encode(t or "").ids)
    assert got == sorted([(i, len((t or "").encode()), n(t), n(t) > 512) for i, t in rows], key=str)
    assert count_tokens(frame(spark, []), byte[0]).collect() == []


def test_rare_pieces_are_joined(spark, byte):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts(6, 300))] + [(900, "x" * 5000), (901, "漢字<|endoftext|>かな " * 3), (901, "漢字<|endoftext|>かな " * 3), (902, None)]
    n = lambda t: len(byte[1].encode(t or "", add_special_tokens=False).ids)
    want = sorted([(i, len((t or "").encode()), n(t), n(t) > 512) for i, t in rows], key=str)
    for common in (0, 20):
        assert sorted((tuple(r) for r in count_tokens(frame(spark, rows), byte[0], common_rows=common).collect()), key=str) == want
