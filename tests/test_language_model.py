import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from larkspur.operators import language_model as lm

SF = "/root/testdata/sf0.001"
HINDI = "यह एक किताब है और मेरा नाम राम है। मैं घर जा रहा हूँ। तुम कहाँ हो? यह बहुत अच्छा है। वे लोग काम कर रहे हैं और हम खाना खा रहे हैं।"
MARATHI = "हे एक पुस्तक आहे आणि माझे नाव राम आहे. मी घरी जात आहे. तू कुठे आहेस? हे खूप छान आहे. ते लोक काम करत आहेत आणि आम्ही जेवण करत आहोत."


def brute(train, text):
    """Naive Bayes over all n-grams."""
    cut = lambda t: [x for w in re.findall(r"[^\W\d_]+", t.lower()) for n in (1, 2, 3) for s in [w if n == 1 else f" {w} "] for x in [s[i : i + n] for i in range(len(s) - n + 1)] for x in [(n, x)]]
    counts = {k: Counter(x for t in own for x in cut(t)) for k, own in train.items()}
    scores = {}
    for k, c in counts.items():
        of = {n: (sum(v for (m, _), v in c.items() if m == n), sum(m == n for m, _ in c)) for n in (1, 2, 3)}
        scores[k] = sum(math.log((c[x] + 0.5) / (of[x[0]][0] + 0.5 * (of[x[0]][1] + 1))) for x in cut(text))
    return scores


def test_scores_against_brute_force(spark):
    train = {"en": ["The cat sat on the mat.", "A dog and a cat"], "de": ["Der Hund und die Katze", "Das ist ein Hund, über"], "x": ["zzz"]}
    model = lm.fit(spark.createDataFrame([(k, t) for k, own in train.items() for t in own] + [(None, "zz"), ("en", None)], "lang string, text string"))
    assert model.languages == ("de", "en", "x")
    asked = ["the dog", "die Katze über alles", "Zz", "cat cat 99"]
    got = {r.k: r for r in lm.detect(spark.createDataFrame(list(enumerate(asked)), "k int, text string"), model, ["k"], margin=0.0).collect()}
    for k, t in enumerate(asked):
        a, b = sorted(brute(train, t).items(), key=lambda x: -x[1])[:2]
        assert got[k].language == a[0] and got[k].margin == pytest.approx(a[1] - b[1])


def test_what_cannot_be_told(spark):
    model = lm.fit(spark.createDataFrame([("en", "the cat"), ("de", "die katze")], "lang string, text string"))
    rows = [(1, None), (2, ""), (3, "12 !"), (4, "漢字"), (5, "the the the")]
    got = {r.k: r.language for r in lm.detect(spark.createDataFrame(rows, "k int, text string"), model, ["k"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: "en"}
    with pytest.raises(ValueError):
        lm.fit(spark.createDataFrame([], "lang string, text string"))


def test_one_script_two_languages(spark):
    """Hindi and Marathi are both written in Devanagari."""
    model = lm.fit(spark.createDataFrame([("hi", HINDI), ("mr", MARATHI)], "lang string, text string"))
    rows = [(1, "मेरा घर बहुत अच्छा है"), (2, "माझे घर खूप छान आहे"), (3, "वे कहाँ जा रहे हैं"), (4, "ते कुठे जात आहेत")]
    assert {r.k: r.language for r in lm.detect(spark.createDataFrame(rows, "k int, text string"), model, ["k"]).collect()} == {1: "hi", 2: "mr", 3: "hi", 4: "mr"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lm.fit(docs.where("doc_id % 5 > 0"), keep=3000)
    held = docs.where("doc_id % 5 = 0")
    got = held.join(lm.detect(held, model, ["doc_id"]), "doc_id").select("lang", "language", F.length("text").alias("n")).collect()
    long = [r for r in got if r.n >= 100]
    assert sum(r.lang == r.language for r in long) / len(long) > 0.98
    assert model.table.count() <= 3 * 3000


def test_match_rates(spark):
    model = lm.fit(spark.createDataFrame([("en", "the cat and the dog"), ("de", "die katze und der hund")], "lang string, text string"))
    rows = [("a", 1, "the dog and cat", "en"), ("a", 2, "und die katze", "en"), ("b", 1, "the the", "de"), ("b", 2, "und der hund", "de"), ("b", 3, None, "de")]
    got = {r.c: (r.requested_language_match_rate, r.first_turn_match) for r in lm.match_rates(spark.createDataFrame(rows, "c string, turn int, text string, language string"), model, key="c").collect()}
    assert got == {"a": (0.5, 1.0), "b": (pytest.approx(1 / 3), 0.0)}


def test_ngrams_are_cut_in_the_tasks(spark):
    """Scoring a text makes no rows of its n-grams and joins none."""
    model = lm.fit(spark.createDataFrame([("en", "the cat"), ("de", "die katze")], "lang string, text string"))
    plan = lm.detect(spark.createDataFrame([(1, "the the cat")], "k int, text string"), model, ["k"])._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Join" not in plan


@pytest.mark.parametrize("orders", [(1, 2, 3), (2,), (3, 1), (5,)])
def test_ngrams_of_words(orders):
    asked = ["the", "é", "cat", "the", "𝒳𝒴", "मेरा", "anna"]
    want = Counter((n, k, p[i : i + n]) for n in orders for k, w in enumerate(asked) for p in [w if n == 1 else f" {w} "] for i in range(len(p) - n + 1))
    assert Counter((n, k, found[g]) for n, found, which, of in lm._grams(pa.array(asked), orders) for g, k in zip(which, of, strict=True)) == want
    assert not [x for _, found, *_ in lm._grams(pa.array([], pa.string()), orders) for x in found]


def test_counts_of_words_in_several_languages(spark, monkeypatch):
    """A model doesn't depend on how many words are cut at a time; a word can belong to several languages."""
    rows = [("en", "a cat sat and sat"), ("de", "a katze sat"), ("en", "cat"), (None, "x"), ("fr", None), ("fr", "1 2")]
    texts = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    model = lm.fit(texts)
    assert model.languages == ("de", "en")
    got = {r.gram: math.exp(r.p1 - model.unseen[int(r.gram[0])][1]) for r in model.table.collect()}
    assert got["1a"] == pytest.approx(2 * 6 + 1) and got["3sat"] == pytest.approx(2 * 2 + 1) and got["2k"[:1] + " k"] == pytest.approx(1.0)
    monkeypatch.setattr(lm, "WORDS", 1)
    again = lm.fit(texts)
    assert sorted(again.table.collect()) == sorted(model.table.collect()) and again.unseen == model.unseen


EN = "The old house stands by the river and the children are playing in the garden with a small dog. "
DE = "Das alte Haus steht am Fluss und die Kinder spielen im Garten mit einem kleinen Hund unter dem Baum. "


def test_a_quoted_passage_does_not_decide(spark):
    """A longer passage in another language is inside the text; a text in two halves goes by what is more."""
    model = lm.fit(spark.createDataFrame([("en", EN), ("de", DE)], "lang string, text string"))
    rows = [(1, EN + 3 * DE + EN), (2, DE + 3 * EN + DE), (3, EN + 2 * DE), (4, 2 * EN + DE), (5, EN), (6, DE), (7, None)]
    asked = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    got = {quote: {r.k: r.language for r in lm.detect(asked, model, ["k"], quote=quote).collect()} for quote in (None, 10.0)}
    assert got[10.0] == {1: "en", 2: "de", 3: "de", 4: "en", 5: "en", 6: "de", 7: None}
    assert got[None] == got[10.0] | {1: "de", 2: "en"}


@pytest.mark.parametrize("piece", [1, 3, 100])
def test_gain_of_a_run_against_all_runs(monkeypatch, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    draw = np.random.default_rng(3)
    values = draw.normal(size=(3, 20))
    for n in (0, 1, 2, 9):
        words = draw.integers(0, 20, n)
        runs = [words[i:j] for i in range(n) for j in range(i, n + 1)]
        want = [max([0.0, *((values[m, r] - values[own, r]).sum() for r in runs for m in range(3))]) for own in range(3)]
        assert lm._quoted(words, values) == pytest.approx(want)
