import hashlib
import random

import pytest

from larkspur.functions import persona
from larkspur.operators import picks


def fits(task, tags):
    return all(t in tags for t in task["tags"] or [] if t is not None and not t.split(":", 1)[-1] == "any" or (t is not None and ":" not in t and t not in tags))


def brute_pick(person, tasks, levels, seed=0, weighted=False):
    tags = set(person["tags"] or [])
    for place, (columns, by_tags) in enumerate([*((c, True) for c in levels), (levels[-1], False)]):
        own = [t for t in tasks if all(t[c] is not None and t[c] == person[c] for c in columns)]
        asked = lambda t: sorted({x for x in t["tags"] or [] if x is not None and not (":" in x and x.split(":")[1] == "any")}) if by_tags else []  # noqa: B023, E731
        own = [t for t in own if set(asked(t)) <= tags]
        if own:
            own.sort(key=lambda t: (asked(t), t["kind"], t["task_id"]))
            w = [max(1e-6, (person["weights"] or {}).get(t["kind"], 1.0)) if weighted else 1.0 for t in own]
            digest = hashlib.md5(f"{person['id']}|pick|{seed}".encode()).hexdigest()
            u = int(digest[:12], 16) / 2**48 * sum(w)
            for t, x in zip(own, w, strict=True):
                if u < x:
                    return t["task_id"], place
                u -= x
    return None, None


@pytest.mark.parametrize("weighted", [False, True])
def test_picks_against_all_pairs(spark, weighted):
    rnd = random.Random(7)
    every = ["age:1", "age:2", "job:a", "job:b", "bare"]
    tasks = [
        {"task_id": f"t{k:03}", "place": rnd.choice(["p", "q", "r", None]), "domain": rnd.choice("xy"), "kind": rnd.choice("uv"), "tags": rnd.choice([None, [], ["age:any"], rnd.sample(every, rnd.randint(1, 3)), ["age:1", "job:any"]])} for k in range(60)
    ]
    people = [{"id": k, "place": rnd.choice(["p", "q", "s", None]), "domain": rnd.choice("xyz"), "tags": rnd.choice([None, rnd.sample(every, rnd.randint(0, 4))]), "weights": rnd.choice([None, {"u": 4.0}, {"u": 0.0, "v": 2.0}])} for k in range(150)]
    p = spark.createDataFrame([tuple(x.values()) for x in people], "id int, place string, domain string, tags array<string>, weights map<string,double>")
    t = spark.createDataFrame([tuple(x.values()) for x in tasks], "task_id string, place string, domain string, kind string, tags array<string>")
    levels = (("place", "domain"), ("domain",))
    got = {r.id: (r.task_id, r.level) for r in picks.pick(p, t, key="id", levels=levels, kind="kind", weights="weights" if weighted else None).collect()}
    want = {x["id"]: brute_pick(x, tasks, levels, weighted=weighted) for x in people}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and set(dict(want.values()).values()) == {0, 1, None} | ({2} & {v[1] for v in want.values()})
    assert sum(got[k] == want[k] for k in want) == len(want)


def test_nothing_to_pick(spark):
    p = spark.createDataFrame([(1, ["a"]), (None, ["a"])], "id int, tags array<string>")
    t = spark.createDataFrame([], "task_id string, tags array<string>")
    assert [tuple(r) for r in picks.pick(p, t, key="id").collect()] == [(1, None, None)]
    t = spark.createDataFrame([("t", ["b"])], "task_id string, tags array<string>")
    assert [tuple(r) for r in picks.pick(p, t, key="id").collect()] == [(1, "t", 1)]


def brute_plan(genres, target):
    out, n = [], 0
    lists = [(g, list(dict.fromkeys(a or []))) for g, a in genres]
    while any(len(a) > n for _, a in lists) and len(out) < target:
        for g, a in lists:
            if len(a) > n and len(out) < target:
                out.append((len(out), g, a[n]))
        n += 1
    return out


def test_plans_against_a_loop(spark):
    rnd = random.Random(1)
    rows = [(k, [(f"g{i}", rnd.choice([None, [rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 7))]])) for i in range(rnd.randint(0, 5))], rnd.randint(0, 20)) for k in range(40)] + [(99, None, 3)]
    df = spark.createDataFrame(rows, "id int, genres array<struct<genre:string,angles:array<string>>>, target_docs int")
    got = sorted(tuple(r) for r in picks.document_plan(df, key="id").collect())
    assert got == sorted((k, *s) for k, g, t in rows for s in brute_plan(g or [], t))


def test_regions(spark):
    rows = [
        (1, "pt_BR", "sp", None, "northeast"), (2, "pt_BR", None, "Mato Grosso do Sul", "south"), (3, "pt_BR", "xx", "São  Paulo, capital", "south"), (4, "pt_BR", None, "ceara", "north"),
        (5, "en_GB", None, None, "Yorkshire and the Humber"), (6, "en_GB", None, None, "northern ireland"), (7, "de_DE", None, None, "Sachsen-Anhalt"), (8, "de_DE", None, None, "THÜRINGEN"),
        (9, "de_DE", None, None, "London"), (10, None, None, None, "London"), (11, "en_GB", None, " ", None),
    ]
    df = spark.createDataFrame(rows, "id int, locale string, state_abbrev string, state string, region string")
    got = {r.id: r.region_tag for r in persona.regions(df, persona.gazetteer(spark), fields=["state_abbrev", "state", "region"]).collect()}
    assert got == {1: "southeast", 2: "central-west", 3: "southeast", 4: "northeast", 5: "england", 6: "northern-ireland", 7: "sachsen-anhalt", 8: "thueringen", 9: None, 10: None, 11: None}
