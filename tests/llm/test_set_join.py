"""The pipeline's near copies against brute-force Jaccard."""

import random

from larkspur.llm import set_join


def brute_keep(rows, words=5, similarity=0.8):
    """Ids that stay: the smallest of each group linked by exact Jaccard similarity."""
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            union = len(sets[a] | sets[b])
            if a < b and (not union or len(sets[a] & sets[b]) / union >= similarity):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def near_rows(seed):
    """Pairs on both sides of 0.8, a passage that many share, chains and a large group."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(5000)]
    draw = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage = draw(60)
    rows = []
    for i in range(70):
        base = draw(rnd.choice([1, 4, 5, 30, 100, 400]))
        rows.append((10 * i + 1, base))
        size = len(base)
        share = rnd.uniform(0.65, 1)
        # a tail of other words gives the similarity s / (2 - s)
        rows.append((10 * i, base[: int(size * share)] + draw(size - int(size * share))))
        rows.append((10 * i + 2, base[: int(size * (share + 1) / 2)]))
        rows.append((10 * i + 3, passage + draw(rnd.choice([5, 20, 100]))))
    hot = draw(200)
    for i in range(60):
        words = list(hot)
        words[rnd.randrange(200)] = rnd.choice(vocab)
        rows.append((2000 + i, words))
    return [(i, " ".join(w)) for i, w in rows] + [(5000, ""), (5001, " \n ")]


def test_near_copies_are_exact(spark, monkeypatch):
    import corpus_pipeline as p

    for seed, one_in in ((1, 16), (2, 1)):  # the order of the shingles doesn't matter
        monkeypatch.setattr(set_join, "ONE_IN", one_in)
        rows = near_rows(seed)
        df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        kept = {r.doc_id for r in p.near_copies(spark, df, "").collect()}
        assert kept == brute_keep(rows) and len(kept) < len(rows) - 60


def brute_rows(rows, words=5, similarity=0.8):
    """(id, text) that stay, ids repeated and missing."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = {s: s for s in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if not (a | b) or len(a & b) / len(a | b) >= similarity:
                root[find(a)] = find(b)
    groups = {}
    for s, (i, t) in zip(sets, rows, strict=True):
        groups.setdefault(find(s), []).append((i, t or "", s))
    kept = []
    for own in groups.values():
        ids = [i for i, _, _ in own if i is not None]
        # of several rows with the smallest id any one may stay: the count and the id are checked
        kept.append(min(ids) if ids else None)
    return sorted(kept, key=str)


def test_near_copies_by_row(spark):
    import corpus_pipeline as p

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    of = lambda rows: sorted(((r.doc_id, r.text) for r in p.near_copies(spark, spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema), "").collect()), key=str)
    assert of([(1, "one text here"), (None, "one text here"), (None, "another thing entirely")]) == [(1, "one text here"), (None, "another thing entirely")]
    assert of([(3, "one text here"), (5, "one text here"), (5, "another thing entirely")]) == [(3, "one text here"), (5, "another thing entirely")]
    assert of([(5, "ONE text here"), (5, "one text here")]) in ([(5, "ONE text here")], [(5, "one text here")])
    rnd = random.Random(8)
    vocab = [f"w{k}" for k in range(300)]
    for _ in range(2):
        rows = []
        for _ in range(25):
            base = [rnd.choice(vocab) for _ in range(rnd.choice([2, 30, 60]))]
            for _ in range(rnd.randint(1, 4)):
                words = list(base)
                if rnd.random() < 0.4:
                    words[rnd.randrange(len(words))] = rnd.choice(vocab)
                rows.append((rnd.choice([None, rnd.randint(1, 20), rnd.randint(1, 200)]), " ".join(words)))
        rows += [rnd.choice(rows) for _ in range(10)] + [(None, None), (7, ""), (2, " ")]
        assert sorted((i for i, _ in of(rows)), key=str) == brute_rows(rows)


def test_groups_of_nothing(spark):
    assert set_join.similar_groups(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
