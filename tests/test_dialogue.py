import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.operators import dialogue, retrieval, sampling, scoring
from larkspur.plans import queries as plans


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "assistant", "more"), (1, 4, "user", " "), (2, 0, "assistant", "first"), (2, 1, "user", "q")]
    return spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")


def test_previous_user(turns):
    got = {(r.conv_id, r.turn): r.user_text for r in dialogue.previous_user(turns).collect()}
    assert got == {(1, 2): "hi", (1, 3): "hi", (2, 0): None}


def test_public(turns):
    m = dialogue.to_messages(turns)
    got = {r.conv_id: r.d for r in m.select("conv_id", dialogue.public_dialogue(F.col("messages")).alias("d")).collect()}
    assert got[2] == "assistant: first\nuser: q" and "system" not in got[1]
    assert m.where("conv_id = 1").select(dialogue.turns_of(F.col("messages"), "user").alias("t")).first().t == ["hi"]


@pytest.mark.parametrize("wanted, found, want", [([], ["a"], True), (["a", "c"], ["a", "b", "c"], True), (["c", "a"], ["a", "b", "c"], False), (["a", "a"], ["a"], False)])
def test_subsequence(spark, wanted, found, want):
    df = spark.createDataFrame([(wanted, found)], "w array<string>, f array<string>")
    assert df.select(dialogue.is_subsequence(F.col("w"), F.col("f")).alias("x")).first().x is want


def test_passages(spark):
    df = spark.createDataFrame([("k", 0, 5), ("k", 3, 4), ("k", 5, 7), ("k", 9, 10), ("l", 1, 2)], "k string, start int, end int")
    assert sorted((r.k, r.start, r.end) for r in dialogue.merge_passages(df, key="k").collect()) == [("k", 0, 7), ("k", 9, 10), ("l", 1, 2)]


def test_passages_without_start_or_end_as_in_sql(spark, tmp_path):
    """Spans without a start come last in the SQL, and those without an end last of their start."""
    rows = [(1, None, 1), (1, 1.0, 2), (1, 2.0, None), (1, 4.0, 1), (2, None, None), (3, 5.0, None), (3, 5.0, 1), (3, 9.0, 1), (None, 1.0, 1), (None, None, 2)]
    spark.createDataFrame(rows, "l_partkey long, l_quantity double, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    got = [tuple(r) for r in plans.QUERIES["merge_passages"](spark, str(tmp_path)).select("l_partkey", "start", "end").collect()]
    assert sorted(got, key=str) == sorted(c.execute(plans.SQL["merge_passages"]).fetchall(), key=str)


def test_contradictions(turns, spark):
    flagged = spark.createDataFrame([(1, 2), (1, 9)], "conv_id int, exchange int")
    assert [(r.exchange, r.user_text, r.reply) for r in dialogue.contradictions(turns, flagged).collect()] == [(2, "hi", "more")]


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, WORLD hello 漢字かな x1",)], "t string")
    assert sorted(df.select(retrieval.tokens(F.col("t")).alias("x")).first().x) == sorted(["hello", "world", "漢字", "字か", "かな", "x1"])


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), (None, [1.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    assert df.select(retrieval.cosine(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(want)


def test_golden(spark):
    gold = spark.createDataFrame([(1, "g1", 0), (1, "g2", 1)], "query_id int, doc_id string, position int")
    lexical = spark.createDataFrame([(1, "g2", 1), (1, "x", 2), (1, "y", 3)], "query_id int, doc_id string, rank int")
    got = retrieval.golden(gold, lexical, k=3, distractors=1).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["g1", "g2", "x"]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(300).withColumn("locale", F.col("id") % 3)
    pick = lambda d: {r.id for r in sampling.sample(d, "per_locale", 5, key="id", seed=1).collect()}
    assert pick(df) == pick(df.repartition(7)) and len(pick(df)) == 15


def test_missing_rows(spark):
    planned = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, v int")
    saved = spark.createDataFrame([("b",), (None,)], "k string")
    assert sorted(str(r.k) for r in sampling.missing_rows(planned, saved, ["k"]).collect()) == ["None", "a"]


def test_registry():
    with pytest.raises(ValueError):
        scoring.register_scorer(scoring.scorer("response_shape"))
    with pytest.raises(KeyError):
        scoring.scorer("none")


def test_scorer_columns(spark):
    df = spark.createDataFrame([(["Fine, thanks.", "ok"], "en"), ([], "en")], "turns array<string>, language string")
    rows = scoring.apply_scorer(df, "response_shape").collect()
    assert rows[0]["shape.empty_or_trivial_rate"] == 0.5 and rows[0].status_proposal is False and rows[1].status_proposal is None


def test_refusals(spark):
    df = spark.createDataFrame([(["I'm unable to do that.", "Das kann ich nicht."], "en")], "turns array<string>, language string")
    r = scoring.apply_scorer(df, "refusal_basics").first()
    assert r["refusal.detected_rate"] == 1.0 and r["refusal.in_wrong_language_rate"] == 0.5


@pytest.mark.parametrize("block", [3, 1000])
def test_near_duplicates(spark, block):
    import random

    rnd = random.Random(2)
    base = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, rnd.choice("ab"), [x + rnd.gauss(0, 0.05) for x in base[i % 5]]) for i in range(30)] + [(90, "a", None), (91, "a", [0.0] * 6), (92, None, base[0]), (93, None, base[0]), (94, "a", [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    cos = lambda x, y: dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5
    want = {(g, a, b) for a, g, x in rows for b, h, y in rows if a < b and g == h and x and y and len(x) == len(y) and any(x) and any(y) and cos(x, y) >= 0.9}
    got = [(r.g, r.left, r.right) for r in retrieval.near_duplicates(df, 0.9, key="id", vector="v", within=["g"], block=block).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("scope", [[], ["g"]])
def test_dense_topk(spark, scope):
    import random

    rnd = random.Random(4)
    rows = [(i, "ab"[i % 2], [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(40)] + [(90, "a", None), (91, "a", [1.0]), (92, None, [1.0, 0.0, 0.0])]
    docs = spark.createDataFrame(rows, "doc_id int, g string, vector array<float>")
    asked = rows[:7]
    queries = spark.createDataFrame(asked, "query_id int, g string, vector array<float>")
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))

    def cos(x, y):
        norms = (dot(x, x) * dot(y, y)) ** 0.5
        return round(dot(x, y) / norms, 9) if len(x) == len(y) and norms else 0.0

    want = set()
    for q, g, x in asked:
        near = sorted((-cos(x, y), d) for d, h, y in rows if y and (not scope or g == h))[:5]
        want |= {(q, d, r + 1) for r, (_, d) in enumerate(near)}
    got = retrieval.dense_topk(queries, docs, 5, scope=scope, doc_block=9, query_block=2).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want


def test_tokens_in_unicode_forms(spark):
    texts = ["Cafe\u0301 STRASSE ﬁne", "café straße FINE", "ﾃﾞｰﾀ Ｘ１", "データ x1", "plain ASCII text_9", None, "a漢字b", "e\u0301"]
    got = [set(r.x) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(retrieval.tokens(F.col("t")).alias("x")).collect()]
    assert got[0] == got[1] == {"café", "strasse", "fine"} and got[2] == got[3] == {"デー", "ータ", "x1"}
    assert got[4] == {"plain", "ascii", "text", "9"} and got[5] == set() and got[6] == {"a", "漢字", "b"} and got[7] == {"é"}


def brute_retrieval(queries, docs, k, mode):
    """queries and docs: (id, scope, text, vector)."""
    out = []
    for q, g, text, v in queries:
        own = [d for d in docs if d[1] == g and g is not None]
        lex = {d[0]: float(len(set(retrieval.word_tokens(text or "")) & set(retrieval.word_tokens(d[2] or "")))) for d in own}

        def cos(w, v=v):
            if not v or not w or len(v) != len(w) or not any(v) or not any(w):
                return 0.0
            return round(sum(a * b for a, b in zip(v, w)) / (sum(a * a for a in v) * sum(b * b for b in w)) ** 0.5, 9)

        dense = {d[0]: cos(d[3]) for d in own}
        if mode == "lexical" or not v or not any(d[3] for d in own):
            score = {d: s for d, s in lex.items() if s}
        elif mode == "dense":
            score = {d[0]: dense[d[0]] for d in own if d[3]}
        else:
            span = lambda x: {d: (s - min(x.values())) / (max(x.values()) - min(x.values())) if max(x.values()) - min(x.values()) >= 1e-9 else 0.0 for d, s in x.items()}
            a, b = span(lex), span(dense)
            score = {d: round(0.5 * a[d] + 0.5 * b[d], 9) for d in a}
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, d, s, n + 1) for n, (d, s) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("mode", ["lexical", "dense", "hybrid"])
def test_retrieval_against_brute_force(spark, monkeypatch, mode):
    import random

    rnd = random.Random(3)
    words = ["alpha", "beta", "Straße", "漢字かな", "ﾃﾞｰﾀ", "café", "x1", "the"]
    row = lambda i: (i, rnd.choice(["a", "b", "c", None]), rnd.choice([None, "", " ".join(rnd.choices(words, k=rnd.randint(1, 6)))]), rnd.choice([None, [], [0.0, 0.0], [float(rnd.randint(-2, 2)) for _ in range(2)], [1.0, 2.0, 3.0]]))
    docs, queries = [row(i) for i in range(90)], [row(i) for i in range(25)]
    docs = [(i, g, t, None if g == "c" else v) for i, g, t, v in docs]
    monkeypatch.setattr(retrieval, "CELLS", 40)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    q = spark.createDataFrame(queries, "query_id long, g string, text string, vector array<double>")
    d = spark.createDataFrame(docs, "doc_id long, g string, text string, vector array<double>").repartition(3)
    got = sorted((r.query_id, r.doc_id, r.score, r["rank"]) for r in retrieval.retrieve(q, d, 4, mode=mode, scope=["g"]).collect())
    want = brute_retrieval(queries, docs, 4, mode)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want])


def test_lexical_plan_has_no_nested_loop(spark):
    q, d = spark.createDataFrame([(1, "a b")], "query_id long, text string"), spark.createDataFrame([(1, "b c")], "doc_id long, text string")
    assert "NestedLoop" not in retrieval.lexical_topk(q, d)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.lexical_topk(q, d.limit(0)).collect() == retrieval.lexical_topk(q.limit(0), d).collect() == []
    gold = spark.createDataFrame([(1, 7, 0)], "query_id long, doc_id long, position int")
    assert [(r.doc_id, r.score, r["rank"]) for r in retrieval.retrieve(q, d, 3, mode="golden", gold=gold).orderBy("rank").collect()] == [(7, None, 1), (1, None, 2)]


@pytest.mark.parametrize("with_vector", [False, True])
def test_tasks_hold_few_documents_as_python_values(spark, with_vector):
    """all documents of an Arrow batch used to be lists of Python strings at once."""
    import pyarrow as pa

    vector = F.array(F.col("id").cast("double")).alias("_v")
    d = spark.range(0, 1000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("a b")).otherwise("ä b").alias("text"), *[vector] * with_vector)
    q = spark.range(3).select(F.col("id").alias("query_id"), retrieval.tokens(F.lit("b ä")).alias("_t"), *[vector] * with_vector)
    seen = lambda state, key, asked, ids, texts, vectors: state.setdefault("n", []).append((len(ids), int(asked.overlaps(texts).sum())))
    ended = lambda state: pa.RecordBatch.from_pydict({"most": [max(n for n, _ in state["n"])], "rows": [sum(n for n, _ in state["n"])], "shared": [sum(s for _, s in state["n"])]})
    searched = d.select(*retrieval._searched(d, []), *["_v"] * with_vector)
    row = retrieval._scored(searched, next(retrieval._query_blocks(q)), [], "most long, rows long, shared long", seen, ended).first()
    assert row.most <= retrieval.PIECE and (row.rows, row.shared) == (1000, 3 * (500 + 2 * 500))


@pytest.mark.parametrize("name", ["lexical_topk", "golden_retrieval"])
def test_documents_go_through_one_python_worker(spark, name):
    """texts that aren't ASCII used to go through a worker of their own before the search."""
    from larkspur.plans import queries as plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


@pytest.mark.parametrize("name", ["hybrid_topk", "golden_retrieval"])
def test_workers_get_small_batches(spark, name):
    """a worker was sent up to 10,000 documents or 64 MB at a time, and keeps two batches."""
    import pyarrow as pa

    from larkspur import shipping
    from larkspur.plans import queries as plans

    keys = [f"spark.sql.execution.arrow.max{what}PerBatch" for what in ("Records", "Bytes")]
    was = [spark.conf.get(k) for k in keys]
    try:
        for key, value in zip(keys, ("10000", "64m"), strict=True):
            spark.conf.set(key, value)
        plans.QUERIES[name](spark, "/root/testdata/sf0.001")
        sizes = lambda it: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "b": [b.nbytes]}) for b in it)
        for length in (10, 20_000):
            sent = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), length)).mapInArrow(sizes, "n long, b long").collect()
            assert sum(r.n for r in sent) == 3000
            assert max(r.n for r in sent) <= shipping.BATCH_ROWS and max(r.b for r in sent) <= 2 * shipping.BATCH_BYTES
        spark.conf.set(keys[1], "1m")
        shipping.prepare(spark)
        assert spark.conf.get(keys[1]) == "1m"  # smaller ones stay
    finally:
        for key, value in zip(keys, was, strict=True):
            spark.conf.set(key, value)


def test_workers_give_back_what_a_batch_has_freed(spark):
    """Arrow's pool kept freed memory, so a worker grew with the number of batches it had seen."""
    import pyarrow as pa

    d = spark.range(0, 3500, 1, 1).select(F.col("id").alias("doc_id"), F.lit("ä b").alias("text"))
    q = spark.range(3).select(F.col("id").alias("query_id"), retrieval.tokens(F.lit("b ä")).alias("_t"))

    def counted(state, key, asked, ids, texts, vectors):
        if not state:
            state.update(own=pa.default_memory_pool, released=0, rows=0)
            pool = type("Pool", (), {"release_unused": lambda self: state.update(released=state["released"] + 1)})
            pa.default_memory_pool = pool
        state["rows"] += len(ids)

    def ended(state):
        pa.default_memory_pool = state["own"]
        return pa.RecordBatch.from_pydict({"released": [state["released"]], "rows": [state["rows"]]})

    row = retrieval._scored(d.select(*retrieval._searched(d, [])), next(retrieval._query_blocks(q)), [], "released long, rows long", counted, ended).first()
    assert row.rows == 3500 and row.released >= 4


def test_query_block_is_arrays_and_bounded_by_its_tokens(spark, monkeypatch):
    """each task made a Python dict of the block's words, and one of each scope's; only the number of queries bounded a block."""
    import pyarrow as pa

    words = lambda n, first: F.expr(f"transform(sequence(0, {n - 1}), i -> concat('w', i + {first}))").alias("_t")
    q = spark.range(40).select(F.col("id").alias("query_id"), words(50, "id * 25"))
    d = spark.range(20).select(F.col("id").alias("doc_id"), F.lit("w30 w3000").alias("text"))
    entries = lambda state, key, asked, ids, texts, vectors: state.setdefault("n", []).append((sum(len(v) for v in vars(asked).values() if isinstance(v, dict)), int(asked.overlaps(texts).sum())))
    ended = lambda state: pa.RecordBatch.from_pydict({"most": [max((n for n, _ in state.get("n", [])), default=0)], "shared": [sum(s for _, s in state.get("n", []))]})
    found = retrieval._scored(d.select(*retrieval._searched(d, [])), next(retrieval._query_blocks(q)), [], "most long, shared long", entries, ended).collect()
    assert max(r.most for r in found) == 0 and sum(r.shared for r in found) == 20 * 2
    assert len(list(retrieval._query_blocks(q))) == 1
    monkeypatch.setattr(retrieval, "BLOCK_TOKENS", 500)
    blocks = [b["query_id"].to_pylist() for b in retrieval._query_blocks(q)]
    assert len(blocks) == 4 and sorted(sum(blocks, [])) == list(range(40))
