"""op11, op12 and op13 against brute force."""

import base64
import random
import re
import string
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from larkspur.llm import queries
from larkspur.llm.quality_rules import apply_rules, counts, repeated_words
from larkspur.llm.source_audit import audit_sources, terms, top_of_groups
from larkspur.llm.whitening import whiten

SF = "/root/testdata/sf0.001"

# --- op11 ------------------------------------------------------------------------------------------


def brute_audit(docs, min_docs=30, top=50):
    """docs: (lang, source, text); dense, one share for each group and kept term."""
    n, df, of_lang, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source, text = lang or "", source or "", text or ""
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]
        groups.add((lang, source))
        n[lang, source].update(found)
        of_lang[lang].update(found)
        df[lang].update(set(found))
    rows, share = [], lambda c, total, v: 1 + 10**9 * (c + 5) // (total + 5 * v)
    kept = {lang: [t for t, k in df[lang].items() if k >= min_docs] for lang, _ in groups}
    shares = {g: {t: share(n[g][t], sum(n[g][x] for x in kept[g[0]]), len(kept[g[0]])) for t in kept[g[0]]} for g in groups}
    for lang, source in groups:
        p = shares[lang, source]
        total = sum(of_lang[lang][t] for t in kept[lang])
        pairs = [(o, sum(abs(p[t] - shares[lang, o][t]) for t in kept[lang])) for k, o in groups if k == lang and o != source]
        q = {t: share(of_lang[lang][t], total, len(kept[lang])) for t in kept[lang]}
        best = [(t, p[t] - q[t]) for t in kept[lang] if n[lang, source][t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", best)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            rows += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top]
    return sorted(rows)


def audited(df, **more):
    return sorted(tuple(r) for r in df.transform(audit_sources, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_terms():
    assert terms("Éa b_C\x00D9e-ÀÉ".encode()) == [x.encode() for x in ("Éa", "b", "c", "d", "e", "ÀÉ")]
    assert terms(b"") == terms(b" 1 @ [ ` { \x7f") == []


@pytest.mark.parametrize("few", [2, 4096])
def test_audit_against_all_shares(spark, few):
    rnd = random.Random(few)
    words = [a + b for a in ("al", "be", "Ça", "du", "é", "zo") for b in ("", "x", "xy", "xyz", "ß")]
    docs = []
    for k in range(150):
        lang = rnd.choice(["en", "en", "fr", None])
        source = rnd.choice(["a", "a", "a", "b", "c", "é", None])
        docs.append((lang, source, " ".join(rnd.choices(words, [1 + (i * (1 + len(source or ""))) % 7 for i in range(len(words))], k=rnd.randint(0, 30)))))
    docs += [("en", "empty", None), ("xx", "only", "al be"), ("en", "long", "al " * 30_000 + "b" * 50_000)]
    clash = ["term", "n", "docs", "base", "value", "rank", "item", "part"]
    df = spark.createDataFrame([(*d, *["x"] * len(clash)) for d in docs], "lang string, source string, text string, " + ", ".join(f"{c} string" for c in clash)).repartition(5)
    assert audited(df, min_docs=4, top=7, few=few) == brute_audit(docs, 4, 7)


def test_audit_edges(spark):
    schema = "lang string, source string, text string"
    assert audited(spark.createDataFrame([], schema)) == []
    # no kept term: distances are 0, ties go by the item's bytes
    few = spark.createDataFrame([("en", s, "once") for s in ("b", "é", "B")], schema)
    assert audited(few) == sorted(brute_audit([("en", s, "once") for s in ("b", "é", "B")]))
    assert [r[3] for r in audited(few) if r[1] == "b"] == ["B", "é"]


def test_top_of_groups_ties_by_bytes(spark):
    rnd = random.Random(3)
    rows = [(g, "common-prefix-" * 3 + "".join(rnd.choices("abé", k=rnd.randint(0, 9))), rnd.choice([0, 7, 7, 7, 2**40])) for g in "xyz" for _ in range(400)]
    rows = list({(g, i): (g, i, v) for g, i, v in rows}.values())
    df = spark.createDataFrame(rows, "g string, item string, value long").cache()
    for k in (1, 60, 5000):
        got = sorted((r.g, r["rank"], r.item, r.value) for r in top_of_groups(df, ["g"], k, few=3).collect())
        want = []
        for g in "xyz":
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1].encode()))[:k]
            want += [(g, n + 1, i, v) for n, (_, i, v) in enumerate(own)]
        assert got == sorted(want)


def test_audit_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = queries.op11_source_audit(spark, SF)
    want = duck.execute(queries.ORACLE_SQL["op11_source_audit"]).fetchdf()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))


# --- op12 ------------------------------------------------------------------------------------------


def brute_whiten(vectors, components=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(0)
    exact = x * n - s
    c = exact.astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return n, [(int((row * row).sum())) for row in exact], c @ u / np.sqrt(e), e / np.trace(v)


def test_whiten_against_numpy(spark):
    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(400, 6)) @ rnd.normal(size=(6, 6)) * 2
    vectors = [[float(np.float32(c)) for c in v] for v in base]
    bad = [None, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] + [0.0] * 5, [float("-inf")] + [0.0] * 5, [], [1.0, 2.0]]
    rows = [(k, v, "x", 1) for k, v in enumerate(vectors)] + [(1000 + k, v, "x", 1) for k, v in enumerate(bad)] + [(3, vectors[3], "x", 1), (None, vectors[4], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, x string, id int").repartition(4)
    got = whiten(df, components=4).collect()
    n, deviations, w, explained = brute_whiten([*vectors, vectors[3], vectors[4]], 4)
    assert len(got) == 4 * n == 4 * 402 and {r.n for r in got} == {n}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    assert sorted(r.component for r in got if r.vec_id is None) == [1, 2, 3, 4]
    one = [r for r in got if r.vec_id is not None and r.vec_id != 3]
    assert all(r.deviation == deviations[r.vec_id] for r in one)
    sign = {k: np.sign(next(r.whitened for r in one if r.vec_id == 0 and r.component == k) * w[0, k - 1]) for k in range(1, 5)}
    assert max(abs(r.whitened * sign[r.component] - w[r.vec_id, r.component - 1]) for r in one) < 1e-9
    assert max(abs(r.explained / explained[r.component - 1] - 1) for r in one) < 1e-9


def test_whiten_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whiten(spark.createDataFrame([], schema)).collect() == []
    assert whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    one = whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, 0.0, 0.0), (2, 1, 0, None, 0.0, 0.0)]
    # the second dimension is constant: one component has variance
    flat = whiten(spark.createDataFrame([(k, [float(k), 5.0]) for k in range(10)], schema)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in flat) and flat[0].identity_error < 1e-9
    assert {round(r.explained, 9) for r in flat if r.component == 1} == {1.0}
    # equally frequent lengths: the greater one
    mixed = whiten(spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [1.0, 0.0]), (4, [0.0, 3.0])], schema)).collect()
    assert {r.vec_id for r in mixed} == {3, 4}
    with pytest.raises(Exception, match="too large"):
        whiten(spark.createDataFrame([(1, [1e300])], schema)).collect()


def test_whiten_large_entries_exactly(spark):
    vectors = [[float(k % 7) * 2**34, 0.5 * k] for k in range(20)]
    with pytest.raises(Exception, match="doesn't fit a long"):
        whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    vectors = [[2.0**44 + k % 3, 0.5 * k] for k in range(20)]
    got = whiten(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()
    _, deviations, _, explained = brute_whiten(vectors)
    assert all(r.deviation == deviations[r.vec_id] and abs(r.explained / explained[r.component - 1] - 1) < 1e-6 for r in got)


# --- op13 ------------------------------------------------------------------------------------------

WS = " \t\n\x0b\x0c\r"


def brute_counts(text):
    words = [w for w in re.split(f"[{WS}]+", text) if w]
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WS):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


@pytest.mark.parametrize("seed", range(6))
def test_counts_against_all_windows(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        words = rnd.choices(["a", "b", "é", " ", "#*", "<p>", "日本", " "], k=rnd.randint(0, 40)) * rnd.choice([1, 1, 2, 3])
        text = "".join(w + rnd.choice([" ", " ", "\n", "\t ", "\x0b", "\n \n"]) for w in words)
        assert counts(text) == brute_counts(text)
        assert repeated_words(text.encode().split(), 3) == len({i + j for i in range(len(text.encode().split()) - 2) for j in range(3) if (w := text.encode().split())[i : i + 3] in [w[k : k + 3] for k in range(len(w) - 2) if k != i]})


def prose(rnd, n):
    syllables = ["the", "in", "er", "an", "ou", "to", "st", "re", "le", "mi", "ka", "po"]
    return " ".join("".join(rnd.choices(syllables, k=rnd.randint(1, 3))) for _ in range(n)) + "."


def test_bands(spark):
    rnd = random.Random(2)
    clean = [prose(rnd, n) for n in (25, 60, 200, 900, 4000, 30_000)]
    noise = base64.b64encode(rnd.randbytes(9000)).decode()
    keys = " ".join("".join(rnd.choices(string.printable[:94], k=40)) for _ in range(60))
    many = " ".join(f"item{k % 10} value" for k in range(3000))  # repeats, though not in windows that count as junk alone
    wordy = " ".join(noise[k : k + 60] for k in range(0, len(noise), 60))
    half = prose(rnd, 700) + " " + " ".join(base64.b64encode(rnd.randbytes(45)).decode() for _ in range(400))
    texts = [*clean, wordy, keys, many, half, None, "", "few words"]
    df = spark.createDataFrame([(t, k, "x") for k, t in enumerate(texts)], "text string, doc_id long, kept string")
    got = {r.doc_id: r for r in apply_rules(df).collect()}
    assert [got[k].kept for k in range(len(texts))] == [True] * 6 + [False] * 7
    assert [got[k].base_failed for k in range(6, 13)] == [False, False, True, False, True, True, True]
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(t or "")
        data = (t or "").encode()
        assert r.ratio == (len(data) / len(zstandard.ZstdCompressor(level=3).compress(data)) if data else 0.0)


def test_rules_edges(spark):
    schema = "doc_id long, text string"
    assert apply_rules(spark.createDataFrame([], schema)).collect() == []
    long = "word " * 400_000
    rows = apply_rules(spark.createDataFrame([(1, long), (1, long), (None, long)], schema)).collect()
    assert [(r.doc_id, r.n_words, r.n_repeat_words, r.base_failed, r.kept) for r in rows] == [(1, 400_000, 400_000, True, False)] * 2 + [(None, 400_000, 400_000, True, False)]


def test_rules_keep_labelled_documents(spark):
    got = queries.op13_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1"), "doc_id")
    assert got.where(~F.col("base_failed") & ~F.col("kept")).count() == 0
