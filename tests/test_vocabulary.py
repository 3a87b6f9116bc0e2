"""Vocabulary mentions against regular expressions over every entry."""

import random
import re

import pytest

from larkspur.functions.unicode_forms import fold_name, fold_token, with_form
from larkspur.operators import vocabulary as v

NAMES = [("acme", "Acme", False), ("acme", "Acme Labs", False), ("acme", "GPT-4o", False), ("bolt", "GPT", False), ("bolt", "Apple", True), ("bolt", "通义", False), ("cog", "Éclair  2", False), ("cog", "apple", False), ("dev", "ＤｅｅｐＳｅｅｋ", False), ("dev", "artificial", True), ("dev", " ", False)]


def known(spark, names=NAMES):
    return v.entries(spark.createDataFrame([(d, n, a, k) for k, (d, n, a) in enumerate(names)], "developer string, name string, ambiguous boolean, place int"))


def folded_entries(names=NAMES):
    out = {}
    for d, n, a in names:
        if fold_name(n):
            ambiguous = any(fold_name(m) == fold_name(n) and b for e, m, b in names if e == d)
            out.setdefault(fold_name(n), (d, ambiguous))
    return out


def pattern(entry, flags=re.IGNORECASE):
    start = "(?<![0-9a-z])" if re.match("[0-9a-z]", entry) else ""
    end = "(?![0-9a-z])" if re.search("[0-9a-z]$", entry) else ""
    return re.compile(start + r"\s+".join(map(re.escape, entry.split())) + end, flags)


def brute(text, guess=None, ambiguous=False):
    return sorted((m.start(), m.end(), e, d) for e, (d, a) in folded_entries().items() if not a or ambiguous or d == guess for m in pattern(e).finditer(text or ""))


def resolved(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def texts():
    rnd = random.Random(4)
    bits = ["acme", "ACME labs", "Acme\n \tLabs", "gpt-4o", "GPT", "gpt4", "apple", "Apples", "通义", "éclair 2", "ÉCLAIR  25", "deepseek", "artificial", "x", ".", "-", " ", "  "]
    return ["".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randint(0, 14))) for _ in range(120)] + ["", None, "acme " * 500]


def test_mentions(spark):
    rows = [(k, t, ["acme", "bolt", "dev", None][k % 4]) for k, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "k int, text string, guess string").repartition(3)
    every = v.mentions(df, known(spark), ["k"], ambiguous=True, overlapping=True).collect()
    assert sorted(map(tuple, every)) == sorted((k, *s) for k, t, _ in rows for s in brute(t, ambiguous=True))
    best = v.mentions(df, known(spark), ["k"], guess="guess").collect()
    assert sorted(map(tuple, best)) == sorted((k, *s) for k, t, g in rows for s in resolved(brute(t, g)))
    plain = v.mentions(df, known(spark), ["k"], overlapping=True).collect()
    assert sorted(map(tuple, plain)) == sorted((k, *s) for k, t, _ in rows for s in brute(t))


def test_mentions_without_the_table_of_starts(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "k int, text string")
    want = sorted(map(tuple, v.mentions(df, known(spark), ["k"]).collect()))
    monkeypatch.setattr(v, "STARTS", 2)
    monkeypatch.setattr(v, "BROADCAST_ROWS", 2)
    assert sorted(map(tuple, v.mentions(df, known(spark), ["k"]).collect())) == want


def test_no_vocabulary_and_no_texts(spark):
    df = spark.createDataFrame([(1, "acme")], "k int, text string")
    assert v.mentions(df, known(spark, [("a", "", False)]), ["k"]).collect() == []
    assert v.mentions(df.limit(0), known(spark), ["k"]).collect() == []


def test_named_developers_fold(spark):
    rows = [(1, "made by ｄｅｅｐｓｅｅｋ and Ac​me"), (2, "an apple"), (3, "nothing")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r.developers for r in v.named_developers(df, known(spark), ["k"]).collect()}
    assert got == {1: ["acme", "dev"]}
    assert {r.k: r.developers for r in v.named_developers(df, known(spark), ["k"], ambiguous=True).collect()} == {1: ["acme", "dev"], 2: ["bolt"]}


@pytest.mark.parametrize(
    "developer_text, model_text, guess, want",
    [
        ("made by ACME labs!", None, None, ("acme", "developer_text")),
        ("Apple", "GPT-4o", None, ("acme", "model_text")),
        ("Apple", "GPT-4o", "bolt", ("bolt", "developer_text")),
        ("artificial gpt", None, None, ("bolt", "developer_text")),
        ("artificial gpt", None, "dev", ("dev", "developer_text")),
        ("acmeish", None, "cog", ("cog", "guess")),
        ("acmeish", "", "nobody", ("unrecognised", "none")),
        (None, None, None, (None, "none")),
        ("", "ＧＰＴ", None, ("bolt", "model_text")),
    ],
)
def test_claims(spark, developer_text, model_text, guess, want):
    claims = spark.createDataFrame([(developer_text, model_text, guess)] * 2, "developer_text string, model_text string, developer_guess string")
    got = v.claimed_developers(claims, known(spark)).collect()
    assert [(r.developer, r.matched_by) for r in got] == [want] * 2


def test_passages(spark):
    text = "a" * 50 + " acme " + "b" * 30 + " gpt " + "c" * 200 + " acme"
    df = spark.createDataFrame([(1, text)], "k int, text string")
    got = v.passages(v.mentions(df, known(spark), ["k"]), df, ["k"], around=20).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == [(31, 110), (272, len(text))] and all(text[r.start : r.end] == r.passage for r in got)


def test_forms(spark):
    words = ["Café", "café", "STRASSE", "straße", "ﾃﾞｰﾀ", "データ", "Ａbc", "ﬁ", "İ", "plain Text", None, ""]
    df = spark.createDataFrame([(w,) for w in words * 2], "w string")
    rows = with_form(with_form(df, "w", "token", "t"), "w", "name", "n").collect()
    assert len(rows) == 2 * len(words)
    for r in rows:
        assert (r.t, r.n) == ((None, None) if r.w is None else (fold_token(r.w), fold_name(r.w)))
    t = {r.w: r.t for r in rows}
    assert t["Café"] == t["café"] and t["straße"] == t["STRASSE"] and t["ﾃﾞｰﾀ"] == t["データ"] and t["Ａbc"] == "abc"
