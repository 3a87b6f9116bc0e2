"""op5, op7, op8, op9 against brute force, and the pipeline's stages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from larkspur.llm import decontam, line_dedup, simhash
from larkspur.llm.components import components
from larkspur.llm.decontam import contaminated, decontaminate
from larkspur.llm.line_dedup import dedup_lines
from larkspur.llm.quality import keep_quality, score_quality
from larkspur.llm.simhash import near_duplicates

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """Documents with columns named like those that the operators use inside."""
    clash = ["f0", "id", "sig", "node", "held_id", "held_sig", "gone_doc", "gone_lines", "own_sig", "row", "h", "n_lines"]
    return spark.createDataFrame([(t, i, *["x"] * len(clash)) for i, t in rows], "text string, doc_id bigint, " + ", ".join(f"{c} string" for c in clash))


# --- components and SimHash ------------------------------------------------------------------


def brute_roots(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rnd = random.Random(seed)
    links = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5001 + i) for i in range(100)]
    links = [(a, b) for a, b in links if a != b]
    df = spark.createDataFrame([*links, (7, 7)], "a long, b long").repartition(5)
    assert {r.node: r.root for r in components(df).collect()} == brute_roots(links)


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_fingerprint(text, words=4):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_near(rows, distance=4):
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    least = {}
    for i, f in fps:
        if i is not None:
            least[f] = min(least.get(f, i), i)
    links = [(least[a], least[b]) for a in least for b in least if a < b and (a ^ b).bit_count() <= distance]
    roots = brute_roots(links)
    return sorted(((i, f"{f:016x}", roots.get(least.get(f), least.get(f))) for i, f in fps), key=str)


def near_rows(seed):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 60, 300]))]
        for j in range(rnd.randint(1, 6)):
            words = list(base)
            if j and len(words) > 5:
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            rows.append((i * 100 + j * 7, rnd.choice([" ", "\t", "\n"]).join(words)))
    return rows + [(1, None), (2, ""), (3, " \x0b "), (4, "ABC def"), (5, "abc DEF"), (None, "abc def"), (None, "only here"), (5, "abc DEF"), (6, "one")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = near_rows(seed)
    got = near_duplicates(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_near(rows)


def test_large_entries_are_compared_in_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    base = rnd.getrandbits(64)
    fps = list({base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(50)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    monkeypatch.setattr(simhash, "BLOCK", 40)
    links = simhash.near_links(spark.createDataFrame(list(enumerate(signed)), "node long, f0 long"), distance=4, segments=3).collect()
    got = brute_roots([(r.a, r.b) for r in links])
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4
    want = brute_roots([(i, j) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and near(a, b)])
    assert got == want


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(frame(spark, [])).collect() == []


# --- line runs ---------------------------------------------------------------------------------


def brute_lines(rows, least=line_dedup.MIN_WORDS):
    """Mark every line of a run with at least ``least`` words that starts earlier, too, by comparing all pairs of places."""
    docs = {}
    for i, t in rows:
        every = (t or "").split("\n")
        docs[i] = [(j, x) for j, x in enumerate(every) if x.strip(" ")]
    order = sorted(docs, key=lambda i: (i is not None, i))
    places = [(o, i, k) for o, i in enumerate(order) for k in range(len(docs[i]))]
    gone = {i: set() for i in docs}
    for o, i, k in places:
        for p, q, l in places:
            if (p, l) < (o, k):
                n = 0
                while k + n < len(docs[i]) and l + n < len(docs[q]) and docs[i][k + n][1] == docs[q][l + n][1]:
                    n += 1
                if sum(len(re.findall("[\u3040-\u30ff\u4e00-\u9fff]|[^ \u3040-\u30ff\u4e00-\u9fff]+", docs[i][k + m][1])) for m in range(n)) >= least:
                    gone[i] |= {docs[i][k + m][0] for m in range(n)}
    out = []
    for i, t in rows:
        kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])
        out.append((i, kept, len(docs[i]), len(gone[i])))
    return sorted(out, key=str)


def test_repeated_runs_are_maximal(spark):
    """Every run follows its first copy and can't be made longer on either side; together they hold all lines that go."""
    rnd = random.Random(6)
    passage = [f"line number {k} of the passage" for k in range(37)]
    rows = [(k, "\n".join([f"own line of document {k} is here", *passage[rnd.randint(0, 5) : rnd.randint(20, 37)], "", f"end of {k} and nothing else"])) for k in range(12)]
    rows += [(50, "\n".join(passage)), (51, "\n".join(passage[:9] + passage[:9])), (None, "\n".join(passage[30:]))]
    lines = {i: [x for x in t.split("\n") if x.strip()] for i, t in rows}
    runs = line_dedup.repeated_runs(frame(spark, rows)).collect()
    order = lambda i: (i is not None, i or 0)
    gone = defaultdict(set)
    for r in runs:
        a, b, n = lines[r.doc], lines[r.first_doc], r.n_lines
        assert a[r.start : r.start + n] == b[r.first_start : r.first_start + n] and (order(r.first_doc), r.first_start) < (order(r.doc), r.start)
        ahead = r.start + n < len(a) and r.first_start + n < len(b) and a[r.start + n] == b[r.first_start + n]
        # what lies ahead on this copy belongs to a longer run of another one
        assert not ahead or any(o.doc == r.doc and o.start <= r.start + n < o.start + o.n_lines for o in runs)
        gone[r.doc] |= set(range(r.start, r.start + n))
    assert max(r.n_lines for r in runs) >= 20
    want = {i: g for i, _, _, g in brute_lines(rows)}
    assert {i: len(gone[i]) for i in lines} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines(spark, seed):
    rnd = random.Random(seed)
    pool = ["a", "b c", "one two three", "a line of five words", "", " ", "another line that is long", "é è à", "        }", " x  y ", "\u6f22\u5b57\u304b\u306a\u4ea4 end", "\u6f22\u5b57"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9)))) for i in range(14)] + [(90, None), (91, ""), (None, "a line of five words\nb c")]
    got = dedup_lines(frame(spark, rows)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_lines(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a line of five words"), (1, "a line of five words"), (2, "a line of five words")]
    got = sorted((r.doc_id, r.n_removed) for r in dedup_lines(frame(spark, rows)).collect())
    assert got == [(1, 0), (1, 0), (2, 1)]
    assert dedup_lines(frame(spark, [])).collect() == []


def test_lines_of_a_very_long_document(spark):
    """Every second line of 60,000 is repeated; the text is gone through once, not once for each removed line."""
    text = "\n".join(f"a repeated line of five words\nline {k} is not repeated here" for k in range(30_000))
    got = {r.doc_id: r for r in dedup_lines(frame(spark, [(1, text), (2, text), (3, "short")])).collect()}
    assert (got[1].n_lines, got[1].n_removed) == (60_000, 29_999) and (got[2].n_removed, got[2].text) == (60_000, "")
    assert got[1].text == "\n".join(["a repeated line of five words"] + [f"line {k} is not repeated here" for k in range(30_000)])


# --- decontamination -------------------------------------------------------------------------------


ITEM = "A train leaves Boston at 60 km per hour and later Maria boards the second train with 12 apples in her bag"
CHANGED = ITEM.replace("Boston", "Denver").replace("60", "75").replace("Maria", "Nora").replace("12", "9")
BROKEN = "two trains of 5 km and 5 apples meet after 5 km and 5 apples on the long way home"


TEXTS = [
    (f"before that. {ITEM}. after", True),
    (ITEM.upper(), True),
    (f"so it goes {ITEM.lower()}!", True),
    (f"intro words. {CHANGED}. more", False),
    ("A train leaves the yard with nothing but old coal on board", None),
    (" ".join(ITEM.split()[:6]), None),
    ("", None),
    (None, None),
    ("nothing at all to see here today", None),
]


def test_templates(spark):
    """Whether each text holds the item, and with the same values."""
    docs = frame(spark, [(i, t) for i, (t, _) in enumerate(TEXTS)])
    bench = spark.createDataFrame([(ITEM, 10, "z"), (None, 11, "z"), ("tiny one", 12, "z"), (ITEM, 10, "z")], "text string, item_id int, sig string")
    got = sorted((r.doc_id, r.item_id, r.same_values) for r in contaminated(docs, bench).collect())
    assert got == [(i, 10, same) for i, (_, same) in enumerate(TEXTS) if same is not None]
    assert sorted(r.doc_id for r in decontaminate(docs, bench).collect()) == [i for i, (_, same) in enumerate(TEXTS) if same is None]


def test_slots_must_agree(spark):
    """One value of the item must stay one value: here 5 would have to be 5, 6, 7 and 8."""
    bench = spark.createDataFrame([(BROKEN, 1)], "text string, item_id int")
    consistent, mixed = BROKEN.replace("5", "8"), "two trains of 5 km and 6 apples meet after 7 km and 8 apples on the long way home"
    got = contaminated(frame(spark, [(1, consistent), (2, mixed), (3, BROKEN)]), bench).collect()
    assert sorted((r.doc_id, r.same_values) for r in got) == [(1, False), (3, True)]


TREATY = "In which year did the Treaty of Westphalia end the war between Sweden and France?"
APPLES = "Alice has 5 apples. Bob gives her 3 more apples. How many apples does Alice have now?"


def held(spark, *cases):
    """For each (item, texts) whether each text holds that item, and with the same values."""
    bench = spark.createDataFrame([(item, k) for k, (item, _) in enumerate(cases)], "text string, item_id int")
    docs = frame(spark, [(1000 * k + i, t) for k, (_, texts) in enumerate(cases) for i, t in enumerate(texts)])
    got = {(r.doc_id, r.item_id): r.same_values for r in contaminated(docs, bench).collect()}
    return [[got.get((1000 * k + i, k)) for i in range(len(texts))] for k, (_, texts) in enumerate(cases)]


def test_case_lines_and_names_anywhere(spark):
    texts = [TREATY.lower(), TREATY.upper(), TREATY.replace("the Treaty of", "the\n  Treaty\tof"), "in some other year did a treaty of peace end the long war between them"]
    changed = APPLES.replace("Alice", "Carol").replace("Bob", "Dave").replace("5", "8").replace("3", "4")
    got = held(
        spark,
        (TREATY, texts),
        (ITEM, [ITEM.lower(), ITEM.upper(), ITEM.lower().replace("60", "75")]),
        (APPLES, [APPLES, changed, "Carol has 8 pears. Dave sold her 4 old books. How many pears does Erin have now?"]),
    )
    assert got == [[True, True, True, None], [True, True, False], [True, False, None]]


def test_offsets_runs_and_short_items(spark):
    longer = ITEM.replace("Boston", "New York").replace("Maria", "Anna Lee")
    added = TREATY.replace("end the", "at last end the")
    item = "which small river runs along the old wall of the town and under its only bridge"
    words = item.split()
    one_more = " ".join([*words[:8], "very", *words[8:]])
    one_less = " ".join([*words[:5], *words[6:]])
    got = held(
        spark,
        (ITEM, [longer, longer.replace("60", "75")]),
        (longer, [ITEM]),
        (item, [one_more, one_less, " ".join(reversed(words))]),
        ("Capital of Peru?", [f"so: the capital of\nperu. {added}", "the capital of all peru", "peru"]),
    )
    assert got == [[False, False], [False], [True, True, None], [True, None, None]]


def test_names_that_open_sentences_and_one_to_one_slots(spark):
    item = "Alice buys 3 apples at the shop. Bob buys 4 pears there too."
    # one value of the text stands for two of the item, or the other way round
    same = re.sub("[34]", "8", item)
    texts = [item.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "9"), item.replace("3", "9").replace("4", "7"), same]
    assert held(spark, (item, texts), (same, [item])) == [[False, False, None], [None]]


def test_very_long_and_title_case_texts(spark):
    filler = " ".join(f"word{k % 700} and more" for k in range(60_000))
    title = " ".join(w if w.isdigit() else w.title() for w in ITEM.split())
    assert held(spark, (ITEM, [f"{filler} {CHANGED} {filler}", filler, title, title.replace("60", "61")])) == [[False, None, True, False]]


def brute_tokens(text):
    """(lower-case word, kind) by a reading of the rules of its own: n number, u unit after one, m name in a sentence, s other capitalised word."""
    text = re.sub(r"\s+", " ", text or "")
    out = []
    for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+(?:(?<=\d)[.,](?=\d)[\p{L}\p{M}\p{N}]+)*", text):
        name = regex.match(r"\p{Lu}\p{L}*\p{Ll}", m[0]) is not None
        inside = regex.search(r"[\p{Ll},;] $", text[: m.start()]) is not None
        for part in regex.sub(r"(?<=\d)(?=\p{L})", " ", regex.sub(r"(?<=\d)[.,](?=\d)", "", m[0])).split():
            after = out and out[-1][1] == "n"
            out.append((part.lower(), "n" if regex.match(r"\p{N}", part) else ("m" if inside else "s") if name else "u" if after and part.lower() in decontam.UNITS else ""))
    return out


def brute_held(item, text, size=5):
    """Whether the text holds the item: at some level, in one band of offsets, enough windows with one-to-one values."""
    a, b = brute_tokens(item), brute_tokens(text)
    if 0 < len(a) < size:
        words = [w for w, _ in b]
        return any(words[j : j + len(a)] == [w for w, _ in a] for j in range(len(words)))

    def forms(t):
        """(level, [(token, value or None, word)]): as they are at each level, and merged at the last."""
        for level in ("", "nu", "num", "nums"):
            if not level or any(k and k in level for _, k in t):
                yield level, [(({"m": "N", "s": "N"}.get(k, k)) if k and k in level else w, w if k and k in level else None, j) for j, (w, k) in enumerate(t)]

    def merged(t):
        out = []
        for tok, value, j in list(forms(t))[-1][1]:
            if out and value is not None and tok in "Nn" and out[-1][1] is not None and out[-1][0] == tok:
                out[-1] = (tok, out[-1][1] + " " + value, out[-1][2])
            else:
                out.append((tok, value, j))
        return out

    def hits(xs, ys, own_place):
        places = defaultdict(list)
        for j in range(len(ys) - size + 1):
            places[tuple(y[0] for y in ys[j : j + size])].append(j)
        for i in range(len(xs) - size + 1):
            for j in places.get(tuple(x[0] for x in xs[i : i + size]), []):
                yield (i if own_place else xs[i][2]), ys[j][2], frozenset((x[1], y[1]) for x, y in zip(xs[i : i + size], ys[j : j + size], strict=True) if x[1] is not None)

    def enough(found, n):
        starts = {i for i, _, _ in found}
        words = {i + k for i in starts for k in range(size)}
        return len(starts) >= min(math.ceil(n * 0.8), 9) or len(words) >= math.ceil((n + size - 1) * 0.8)

    def some_band(found, n):
        half = max(4, n // 4)
        bands = defaultdict(set)
        for i, j, pairs in found:
            for band in ((j - i) // half - 1, (j - i) // half):
                bands[band].add((i, 0, pairs))
        for found in bands.values():
            if not enough(found, n):
                continue
            times = Counter(p for _, _, pairs in found for p in pairs)
            best = {}
            for (k, v), c in times.items():
                best[k] = max(best.get(k, (0, "")), (c, v))
            lone = {(k, v) for k, (c, v) in best.items() if not any(v == v2 and (c2, k2) > (c, k) for k2, (c2, v2) in best.items())}
            if enough({f for f in found if f[2] <= lone}, n):
                return True
        return False

    plain = [h for (_, x), (_, y) in [(f, g) for f in forms(a) for g in forms(b) if f[0] == g[0]] for h in hits(x, y, True)]
    if len(a) >= size and some_band(plain, len(a) - size + 1):
        return True
    joined = merged(a)
    return len(joined) < len(a) and len(joined) >= size and some_band(list(hits(joined, merged(b), True)), len(joined) - size + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_held_items_equal_brute_force(spark, seed):
    """Items in texts of the same small vocabulary: as they are, with other case, values, names, words, or in part."""
    rnd = random.Random(seed)
    low = "the a of and train leaves station before noon with old red bags for river town".split()
    names = "Alice Bob Carol Anna Lee York Paris Rome".split()

    def sentence(n):
        return " ".join(rnd.choice(names) if rnd.random() < 0.15 else str(rnd.randint(1, 9)) if rnd.random() < 0.15 else rnd.choice(low) for _ in range(n))

    def change(t):
        words = t.split()
        kind = rnd.randrange(7)
        if kind == 1:
            return rnd.choice([t.lower(), t.upper(), t.title()])
        if kind == 2:
            other = {w: str(rnd.randint(1, 20)) for w in words if w.isdigit()}
            return " ".join(other.get(w, w) for w in words)
        if kind == 3:
            other = {w: rnd.choice(names) for w in names}
            return " ".join(other.get(w, w) for w in words)
        if kind == 4:
            at = rnd.randrange(len(words))
            return " ".join([*words[:at], rnd.choice([*low, *names]), *words[at + rnd.randint(0, 1) :]])
        if kind == 5:
            return " ".join(words[: max(1, int(len(words) * rnd.uniform(0.5, 1)))])
        return t if kind else ". ".join([" ".join(words[:4]), " ".join(words[4:])])

    items = [sentence(rnd.choice([2, 5, 6, 9, 14, 20])) for _ in range(25)]
    texts = [f"{sentence(rnd.randint(0, 12))}. {change(change(rnd.choice(items)))}. {sentence(rnd.randint(0, 12))}" for _ in range(70)]
    bench = spark.createDataFrame([(t, i) for i, t in enumerate(items)], "text string, item_id int")
    got = {(r.doc_id, r.item_id) for r in contaminated(frame(spark, list(enumerate(texts))), bench).collect()}
    want = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if brute_held(x, t)}
    assert got == want and len(want) > 30


def test_planted_items(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    norm = lambda s: " ".join(re.findall(r"[^\W_]+", s.lower()))
    items = [(r.item_id, norm(r.text)) for r in bench.collect()]
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    want = {(d, i) for i, x in items for d, t in texts if x in t}
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()} == want and want
    assert contaminated(docs.limit(0), bench).collect() == [] and contaminated(docs, bench.limit(0)).collect() == []


# --- quality --------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert sum(p == q for p, q in held) / len(held) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in score_quality(docs, flipped).collect()} == {r.doc_id: r.score for r in got}
    kept = {r.doc_id for r in keep_quality(docs, labels).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got if r.predicted}


def test_repeated_ids_are_one_row_of_the_fit(spark, monkeypatch):
    from larkspur.llm import quality

    rnd = random.Random(1)
    texts = [" ".join(rnd.choices(["some", "plain", "words", "here", "and", "there"], k=rnd.randint(3, 60))) for _ in range(60)] + ["very long " * 200_000]
    rows = [(i % 20, t) for i, t in enumerate(texts)] + [(7, "copied row")] * 300 + [(7, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u: sizes.append((len(p), len(u))) or fit(p, u))
    got = score_quality(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 7}) > 1
    assert sizes[0][0] <= 10 and sizes[0][1] <= 20
    again = score_quality(frame(spark, rows).repartition(7), labels).collect()
    assert sorted((r.doc_id, round(r.score, 9)) for r in again) == sorted((r.doc_id, round(r.score, 9)) for r in got)


def test_quality_without_labels(spark):
    docs = frame(spark, [(1, None), (None, "some text"), (3, ""), (3, "")])
    labels = spark.createDataFrame([(1, None)], "doc_id bigint, quality int")
    assert [r.score for r in score_quality(docs, labels).collect()] == [0.5] * 4
    assert keep_quality(docs, labels).count() == 4
    assert score_quality(docs.limit(0), labels).collect() == []


# --- pipeline ----------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in p.STAGES] == ["quality", "lines", "near_copies", "leaks", "tokens"]
    kept = p.quality(spark, docs, SF)
    assert kept.columns == columns and 0 < kept.count() <= docs.count()
    rows = {(r.doc_id, r.text) for r in kept.collect()}
    assert rows <= {(r.doc_id, r.text) for r in docs.collect()}

    lines = p.lines(spark, kept, SF).collect()
    want = {i: t for i, t, n, g in brute_lines([(r.doc_id, r.text) for r in kept.collect()]) if not (g and g == n)}
    assert {r.doc_id: r.text for r in lines} == want and all(r.n_chars == len(r.text) for r in lines)

    near = p.near_copies(spark, spark.createDataFrame(lines, docs.schema), SF)
    assert near.columns == columns
    leaks = p.leaks(spark, near, SF)
    assert leaks.columns == columns and leaks.count() <= near.count()
    out = p.tokens(spark, leaks, SF).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in leaks.collect()} and all(len(r.ids) == r.n_tokens for r in out)


def test_near_copies_stage_keeps_one_of_each(spark):
    import corpus_pipeline as p

    long = " ".join(f"word{i}" for i in range(400))
    rows = [(5, long, "en", "s", 1), (3, long + " extra", "en", "s", 1), (9, "quite another text", "en", "s", 1), (None, "no id", "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(str(r.doc_id) for r in p.near_copies(spark, df, SF).collect()) == ["3", "9", "None"]


def test_near_copies_of_repeated_and_missing_ids(spark):
    import corpus_pipeline as p

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, "one text", "en", "s", 1), (1, "one text", "en", "s", 1), (None, "other text", "en", "s", 1), (None, "other text", "fr", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0)]
    assert sorted((str(r.doc_id), r.text) for r in p.near_copies(spark, spark.createDataFrame(rows, schema), SF).collect()) == [("1", "one text"), ("2", None), ("None", "other text")]
    assert p.near_copies(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_similar_copies_at_128_bits(spark):
    """Copies with a few changed words in a hundred are found, unrelated texts and half-equal ones are left alone."""
    rnd = random.Random(5)
    vocab = [f"w{k}" for k in range(3000)]
    rows, same = [], []
    for i in range(60):
        base = [rnd.choice(vocab) for _ in range(300)]
        near = [rnd.choice(vocab) if k % 97 == 5 else w for k, w in enumerate(base)]  # about 0.9 of the shingles stay
        far = base[:150] + [rnd.choice(vocab) for _ in range(150)]
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(far))]
        same.append((10 * i, 10 * i + 1))
    groups = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), words=5, lanes=2, segments=8, distance=simhash.estimated_distance(0.8, 2)).collect()}
    assert simhash.estimated_distance(0.8, 2) == 19
    assert sum(groups[b] == a for a, b in same) >= 0.9 * len(same)
    assert all(groups[10 * i + 2] == 10 * i + 2 for i in range(60))
