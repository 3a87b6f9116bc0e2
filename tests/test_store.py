import pytest
from pyspark.sql import functions as F

from larkspur.sources import runs


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/data"


def frame(spark, rows, schema="trajectory_id string, locale string, probe_family string, x bigint"):
    return spark.createDataFrame(rows, schema)


def test_runs_and_pruning(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1)]), root, "9")
    runs.write_run(frame(spark, [("b", "en", "p", 2)]), root, "10")
    assert runs.list_runs(spark, root) == ["9", "10"] and runs.resolve_run(spark, root) == "10"
    assert [r.trajectory_id for r in runs.read_dataset(spark, root).collect()] == ["b"]
    assert runs.read_dataset(spark, root, run="all").count() == 2
    with pytest.raises(FileNotFoundError):
        runs.resolve_run(spark, root, "11")
    with pytest.raises(Exception, match="exists"):
        runs.write_run(frame(spark, [("c", "en", "p", 2)]), root, "9")


def test_drift(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1)]), root, "1")
    other = spark.createDataFrame([("b", "en", "p", "text", [1])], "trajectory_id string, locale string, probe_family string, x string, tags array<int>")
    other.write.partitionBy("locale", "probe_family").mode("append").parquet(f"{root}/run=1")
    got = {r.trajectory_id: (r.x, r.tags, r.run) for r in runs.read_dataset(spark, root).collect()}
    assert got == {"a": ("1", None, "1"), "b": ("text", [1], "1")}


def test_replacing_locales(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1), ("b", "de", "p", 2)]), root, "1")
    runs.write_locales(frame(spark, [("c", "de", "q", 3)]), root, "1", ["de"])
    assert {r.trajectory_id for r in runs.read_dataset(spark, root).collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        runs.write_locales(frame(spark, [("c", "fr", "q", 3)]), root, "1", ["de"])
    runs.write_locales(frame(spark, []), root, "1", ["de"])
    assert runs.read_dataset(spark, root).count() == 2


def test_append_only_new(spark, root):
    first = runs.append_new(frame(spark, [("a", "en", "p", 1), ("a", "en", "p", 1)]), root, "1")
    assert first.count() == 1
    runs.append_new(frame(spark, [("a", "en", "p", 1), ("b", "en", "p", 1)]), root, "1")
    assert sorted(r.trajectory_id for r in runs.read_dataset(spark, root).collect()) == ["a", "b"]


def test_first_run_wins(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1)]), root, "1")
    runs.write_run(frame(spark, [("a", "en", "p", 2), ("b", "en", "p", 2)]), root, "2")
    got = {r.trajectory_id: r.x for r in runs.load_runs(spark, root, ["2", "1"]).collect()}
    assert got == {"a": 2, "b": 2}


def test_manifest(spark, root):
    df = frame(spark, [("a", "en", "p", 1)])
    runs.write_curated(df, root, "1", "generous:v1.0", {"total": 1})
    assert runs.read_json(spark, f"{root}/run=1/profile=generous_v1.0/_selection_manifest.json") == {"total": 1}


def test_missing_partition_column(spark, root):
    with pytest.raises(ValueError):
        runs.write_run(frame(spark, [("a", "en", "p", 1)]).drop("locale"), root, "1")


def test_stream_twice(spark, root, tmp_path):
    from larkspur.streaming.ingest import ingest

    source = f"file://{tmp_path}/in"
    frame(spark, [("a", "en", "p", 1), ("b", "en", "p", 2)]).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).withColumn("x", F.col("x") + 1)
        ingest(stream, root, "1", f"{tmp_path}/state-{_}").awaitTermination()
    assert runs.read_dataset(spark, root).count() == 2


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_key_index_against_a_set(spark, root):
    import random

    from larkspur.sources.key_index import KeyIndex

    rnd, held = random.Random(1), set()
    index = KeyIndex(spark, root, "1", buckets=4)
    for n in (3, 1, 9, 2, 2, 2, 40, 2, 2, 2, 2):
        new = {f"k{rnd.randint(0, 10_000)}" for _ in range(n)} - held
        asked = [*new, *rnd.sample(sorted(held), min(5, len(held)))]
        got = [r.key for r in index.stored(keys(spark, *asked, None)).collect()]
        assert sorted(got) == sorted(set(asked) & held)
        index.add(keys(spark, *new, None))
        held |= new
        index = KeyIndex(spark, root, "1")
        assert index.buckets == 4 and sum(s["n"] for s in index.segments) == len(held)
    assert len(index.segments) < 8  # the small ones were merged


def test_filters_spare_the_files(spark, root):
    from larkspur.sources.key_index import KeyIndex

    index = KeyIndex(spark, root, "1", buckets=8)
    index.add(spark.range(4000).select(F.concat(F.lit("a"), "id")))
    index.add(spark.range(3000).select(F.concat(F.lit("b"), "id")))
    assert index.stored(spark.range(50).select(F.concat(F.lit("c"), "id"))).count() == 0
    assert index.read_filters == 2 and index.read_files <= 1  # of 16
    assert index.stored(keys(spark, "b7", "c1")).count() == 1 and 1 <= index.read_files <= 2


def test_append_after_a_crash(spark, root, monkeypatch):
    from larkspur.sources.key_index import KeyIndex

    runs.append_new(frame(spark, [("a", "en", "p", 1)]), root, "1")
    with monkeypatch.context() as m:
        m.setattr(KeyIndex, "add", lambda self, rows: 1 / 0)  # the rows are there, their keys are not
        with pytest.raises(ZeroDivisionError):
            runs.append_new(frame(spark, [("b", "de", "p", 1)]), root, "1")
    runs.append_new(frame(spark, [("a", "en", "p", 9), ("b", "de", "p", 9), ("c", "de", "p", 9), (None, "de", "p", 9)]), root, "1")
    got = sorted((r.trajectory_id or "", r.x) for r in runs.read_dataset(spark, root).collect())
    assert got == [("", 9), ("a", 1), ("b", 1), ("c", 9)]


def test_index_follows_other_writers(spark, root):
    runs.append_new(frame(spark, [("a", "en", "p", 1), ("b", "de", "p", 1)]), root, "1")
    runs.write_locales(frame(spark, [("c", "de", "q", 3)]), root, "1", ["de"])
    runs.append_new(frame(spark, [("b", "de", "p", 5), ("c", "de", "p", 5), ("a", "en", "p", 5)]), root, "1")
    assert sorted((r.trajectory_id, r.x) for r in runs.read_dataset(spark, root).collect()) == [("a", 1), ("b", 5), ("c", 3)]


def test_replacing_a_locale_keeps_it_when_the_write_fails(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1), ("b", "de", "p", 2), ("e", "de", "r/1", 2)]), root, "1")
    bad = frame(spark, [("c", "de", "p", 3)]).withColumn("x", F.when(F.col("x") == 3, F.raise_error("lost").cast("bigint")))
    with pytest.raises(Exception, match="lost"):
        runs.write_locales(bad, root, "1", ["de"])
    assert {r.trajectory_id for r in runs.read_dataset(spark, root).collect()} == {"a", "b", "e"}
    runs.write_locales(frame(spark, [("c", "de", "p", 3), ("d", "de", "r/1", 3)]), root, "1", ["de"])
    assert {r.trajectory_id for r in runs.read_dataset(spark, root).collect()} == {"a", "c", "d"}
    runs.write_locales(frame(spark, [("f", "de", "s", 3)]), root, "1", ["de"])
    assert {r.trajectory_id for r in runs.read_dataset(spark, root).collect()} == {"a", "f"}


def test_locks(spark, root, monkeypatch):
    import time

    with runs.run_lock(spark, root, "1"):
        with pytest.raises(RuntimeError, match="another process"):
            with runs.run_lock(spark, root, "1"):
                pass
    with runs.run_lock(spark, root, "1", stale_s=0.4):
        time.sleep(1.2)  # it is renewed meanwhile
        with pytest.raises(RuntimeError):
            with runs.run_lock(spark, root, "1", stale_s=0.4):
                pass
    fs, base = runs._fs(spark, root)
    lock = spark._jvm.org.apache.hadoop.fs.Path(base, ".lock-1")
    fs.create(lock, False).close()
    fs.setTimes(lock, 1000, -1)
    with runs.run_lock(spark, root, "1"):
        assert fs.exists(lock)
    assert not fs.exists(lock)
    with runs.run_lock(spark, root, "1"):
        fs.delete(lock, False)
        fs.create(lock, False).close()  # taken over by another
    assert fs.exists(lock)


def test_columns_differ_but_not_types(spark, root):
    runs.write_run(frame(spark, [("a", "en", "p", 1)]), root, "1")
    more = spark.createDataFrame([("b", "en", "p", 2, [1])], "trajectory_id string, locale string, probe_family string, x bigint, tags array<int>")
    more.write.partitionBy("locale", "probe_family").mode("append").parquet(f"{root}/run=1")
    df = runs.read_dataset(spark, root)
    assert {r.trajectory_id: (r.x, r.tags, r.locale, r.run) for r in df.collect()} == {"a": (1, None, "en", "1"), "b": (2, [1], "en", "1")}
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def cells(spark, root, rows):
    runs.write_run(frame(spark, rows, "trajectory_id string, locale string, probe_family string, assistant_eval string").coalesce(1), root, "1")


def fresh_cells(spark, **values):
    return spark.createDataFrame(list(values.items()), "trajectory_id string, assistant_eval string")


def stored_cells(spark, root):
    return {r.trajectory_id: r.assistant_eval for r in runs.read_dataset(spark, root).collect()}


def test_only_files_with_changes_are_rewritten(spark, root):
    from larkspur.sources.rewrite import replace_values

    cells(spark, root, [("a", "en", "p", "1"), ("b", "en", "p", "2"), ("c", "de", "p", "3"), ("d", "de", "x y%", "4"), ("e", None, "q", None)])
    before = set(runs._leaf_folders(spark, f"{root}/run=1"))
    assert replace_values(fresh_cells(spark, a="1", c="3", z="9"), root, "1") == {"files": 4, "rewritten": 0, "rows": 0, "changed": 0}
    assert set(runs._leaf_folders(spark, f"{root}/run=1")) == before
    got = replace_values(fresh_cells(spark, a="new", c="no", d="D", e="E"), root, "1", needed=F.col("trajectory_id") != "c")
    assert got == {"files": 4, "rewritten": 3, "rows": 4, "changed": 3}
    assert stored_cells(spark, root) == {"a": "new", "b": "2", "c": "3", "d": "D", "e": "E"}
    after = set(runs._leaf_folders(spark, f"{root}/run=1"))
    assert len(after) == 4 and len(before & after) == 1 and "locale=de/probe_family=p" in min(before & after)


def test_rewrite_keeps_the_key_index(spark, root):
    from larkspur.sources.key_index import KeyIndex
    from larkspur.sources.rewrite import replace_values

    rows = [("a", "en", "p", "1"), ("b", "de", "p", "2")]
    runs.append_new(frame(spark, rows, "trajectory_id string, locale string, probe_family string, assistant_eval string"), root, "1")
    replace_values(fresh_cells(spark, a="A"), root, "1")
    assert KeyIndex(spark, root, "1").current()


@pytest.mark.parametrize("calls", [0, 1, 2, 3])
def test_a_rewrite_that_dies_is_ended_by_the_next(spark, root, monkeypatch, calls):
    """The writer dies before the journal, before or between the exchanges, or before the old files go."""
    from larkspur.sources import rewrite

    cells(spark, root, [("a", "en", "p", "1"), ("b", "de", "p", "2")])
    path, made = rewrite._path, []

    def dying(session, text):
        made.append(text)
        if len(made) > 2 * calls:
            raise SystemError("killed")
        return path(session, text)

    with monkeypatch.context() as m:
        if calls:
            m.setattr(rewrite, "_path", dying)
        else:
            m.setattr(rewrite, "write_json", lambda *a: (_ for _ in ()).throw(SystemError("killed")))
        with pytest.raises(SystemError):
            rewrite.replace_values(fresh_cells(spark, a="A", b="B"), root, "1")
    with runs.run_lock(spark, root, "1"):
        assert rewrite.finish(spark, root, "1") == (1 if calls else 0)
    assert stored_cells(spark, root) == ({"a": "A", "b": "B"} if calls else {"a": "1", "b": "2"})
    assert runs.read_dataset(spark, root).count() == 2 and len(runs._leaf_folders(spark, f"{root}/run=1")) == 2
    assert [n for n in runs._children(spark, f"{root}/run=1") if n.startswith(".")] == []


def test_one_file(spark, root):
    path = f"{root}/panel.parquet"
    for n in (30, 7):
        runs.write_file(spark.range(n).repartition(4), path)
        assert spark.read.parquet(path).count() == n and not runs.is_folder(spark, path)
    bad = spark.range(3).withColumn("id", F.when(F.col("id") == 1, F.raise_error("lost").cast("long")))
    with pytest.raises(Exception, match="lost"):
        runs.write_file(bad, path)
    assert spark.read.parquet(path).count() == 7 and runs._children(spark, root) == ["panel.parquet"]


def test_bank_tables(spark, root):
    from larkspur.sources import banks

    docs = spark.createDataFrame([("7", "d1", "text"), ("b", "d2", None)], "institution_id string, document_id string, body string")
    templates = spark.createDataFrame([("7", "t1")], "institution_id string, template_id string")
    vectors = spark.createDataFrame([("d1", [0.5, 1.0])], "id string, embedding array<double>")
    banks.write_tables(root, {"locale": "en_US"}, documents=docs, templates=templates, vectors=vectors)
    banks.write_tables(root, {"locale": "en_US"}, documents=docs.where("institution_id = '7'"))
    got = banks.read_tables(spark, root)
    assert set(got) == {"documents", "templates", "vectors"}
    assert [(r.institution_id, r.document_id, r.body) for r in got["documents"].collect()] == [("7", "d1", "text")] and got["templates"].count() == 1
    assert banks.load_vectors(spark, f"{root}/vectors").first().embedding == [0.5, 1.0]
    assert runs.read_json(spark, f"{root}/region.json") == {"schema_version": 1, "locale": "en_US"}
    with pytest.raises(ValueError, match="lacks"):
        banks.write_tables(root, {}, documents=docs.drop("document_id"))
    with pytest.raises(ValueError, match="no table"):
        banks.write_tables(root, {}, other=docs)


def test_replayed_batches_use_all_tasks(spark, monkeypatch):
    """each batch used to be read and its repeated keys dropped by two tasks, whatever its size."""
    from larkspur.plans import evidence

    batches = []
    monkeypatch.setattr(evidence.runs, "append_new", lambda df, *a, **k: batches.append(df))
    monkeypatch.setattr(evidence.runs, "read_dataset", lambda spark, root: batches[-1])
    evidence.replayed_appends(spark, "/root/testdata/sf0.001")
    assert len(batches) == 5 and not any("Repartition" in b._jdf.queryExecution().optimizedPlan().toString() for b in batches)
