"""Stable identities, splits and seeded choices, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the parts joined by ``|``; a null part is empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def persona_hash(fields: dict[str, Column], length: int = 16) -> Column:
    """First hex digits of the SHA-256 of the named string fields as canonical JSON (sorted keys, ``null`` for missing)."""

    def quoted(c: Column) -> Column:
        text = F.to_json(F.array(c.cast("string")))
        return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))

    body = [F.concat(F.lit(f'"{k}": '), quoted(fields[k])) for k in sorted(fields)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *body), F.lit("}")), 256), 1, length)


def md5_bucket(key: Column, buckets: int = 10_000) -> Column:
    """The 128-bit MD5 of a key's text modulo ``buckets``, from its two halves."""
    digest = F.md5(key.cast("string"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") % buckets
    return ((half(1) * ((1 << 64) % buckets) + half(17)) % buckets).cast("int")


def split_for(key: Column, holdout: float) -> Column:
    """``holdout`` or ``train`` by the key's bucket; null where no share is held out."""
    if holdout <= 0:
        return F.lit(None).cast("string")
    return F.when(md5_bucket(key) / 10_000 < holdout, "holdout").otherwise("train")


def hash_fraction(*key: Column, seed: int = 0) -> Column:
    """A fraction in [0, 1) that only depends on the key and the seed."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key], F.lit(str(seed)))), 1, 12), 16, 10)
    return bits.cast("double") / float(1 << 48)


def rendezvous_pick(key: Column, entries: Column, seed: str = "") -> Column:
    """The entry of an array<string> with the smallest hash together with the key: removing others never changes it."""
    score = lambda e: F.struct(F.md5(F.concat_ws("|", F.lit(seed), key.cast("string"), e)).alias("h"), e.alias("e"))
    return F.array_min(F.transform(entries, score))["e"]


def weighted_pick(key: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """A category by cumulative weight of the key's fraction."""
    total, so_far, out = sum(weights.values()), 0.0, None
    names = list(weights)
    u = hash_fraction(key, seed=seed)
    for name in names[:-1]:
        so_far += weights[name] / total
        cond = u < so_far
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


# --- persona derivations ----------------------------------------------------------------------


def age_bin(age: Column, edges: Sequence[int] = (25, 35, 45, 55, 65)) -> Column:
    """``under_25``, ``25_34``, ..., ``65_plus``; null for a missing age."""
    out = F.when(age < edges[0], f"under_{edges[0]}")
    for lo, hi in zip(edges, edges[1:], strict=False):
        out = out.when(age < hi, f"{lo}_{hi - 1}")
    return out.when(age.isNotNull(), f"{edges[-1]}_plus")


def trait(score: Column) -> Column:
    """A T-score as a fraction: (t - 20) / 60, between 0 and 1; null without one."""
    return F.when(score.isNotNull(), F.least(F.greatest((score.cast("double") - 20) / 60, F.lit(0.0)), F.lit(1.0)))


def tag_overlap(entry: Column, persona: Column) -> Column:
    """Some tag is shared, or ``prefix:any`` on either side meets the prefix on the other; an entry without tags fits all."""
    prefix = lambda t: F.split_part(t, F.lit(":"), F.lit(1))
    wild = lambda a, b: F.exists(F.filter(a, lambda t: t.endswith(":any")), lambda t: F.exists(b, lambda p: prefix(p) == prefix(t)))
    return (F.size(entry) == 0) | F.arrays_overlap(entry, persona) | wild(entry, persona) | wild(persona, entry)


def tag_each_prefix(entry: Column, persona: Column) -> Column:
    """Each prefix among the entry's tags has a hit; ``prefix:any`` on either side is one; bare tags are all required."""
    prefix = lambda t: F.split_part(t, F.lit(":"), F.lit(1))
    hit = lambda t: F.array_contains(persona, t) | t.endswith(":any") | F.array_contains(persona, F.concat(prefix(t), F.lit(":any")))
    typed = F.filter(entry, lambda t: F.contains(t, F.lit(":")))
    bare = F.filter(entry, lambda t: ~F.contains(t, F.lit(":")))
    per_prefix = F.forall(F.array_distinct(F.transform(typed, prefix)), lambda p: F.exists(typed, lambda t: (prefix(t) == p) & hit(t)))
    return per_prefix & (F.size(F.array_except(bare, persona)) == 0)


def tag_all(entry: Column, persona: Column) -> Column:
    """Every tag that isn't a wildcard is among the persona's; no tags fit all."""
    return F.size(F.array_except(F.filter(entry, lambda t: ~t.endswith(":any")), persona)) == 0


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The name-based UUID (SHA-1) of a text in a namespace, by default that of URLs."""
    raw = F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8"))
    h = F.sha1(raw)
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def setup_fingerprint(**parts: Column) -> Column:
    """SHA-256 of the named parts as canonical JSON, sorted by name; equal setups have equal fingerprints."""
    return F.sha2(F.to_json(F.struct(*[parts[k].cast("string").alias(k) for k in sorted(parts)]), {"ignoreNullFields": "false"}), 256)


def fold_name(name: Column) -> Column:
    """A name as it's compared: full-width forms, case, invisible characters and runs of white space don't count."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
    plain = F.regexp_replace(F.translate(name, wide, narrow), "[​-‏⁠﻿­]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[\s　]+", " "))


def matched_rule(models: DataFrame, rules: DataFrame, *, model: str = "model_id") -> DataFrame:
    """(model, developer, pattern): the rule that decides each distinct model id; null where none does.

    ``rules`` is (place, pattern, developer): patterns with ``*`` and ``?``, case ignored; one without any wildcard is
    a declaration and goes before patterns; then the smallest place decides. A pattern without ``/`` may start after
    any of ``/ : @ . -``. Ids and rules meet by what a pattern has before its first wildcard, which an id, or what follows
    one of these characters in it, must begin with; only such pairs are matched as a whole.
    """
    low = F.lower(F.trim("pattern"))
    escaped = F.regexp_replace(low, r"([\\.\[\]{}()+^$|])", r"\\$1")
    body = F.concat(F.lit("^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    head = F.regexp_extract(low, r"^[^*?]*", 0)
    known = rules.select("place", "pattern", "developer", body.alias("_re"), low.rlike(r"[*?]").alias("_wild"), F.contains(low, F.lit("/")).alias("_whole"), head.alias("_head"))
    lengths = sorted(r[0] for r in known.select(F.length("_head")).distinct().collect())  # as many as patterns have lengths
    ids = models.select(model).distinct()
    name = F.lower(F.trim(F.col(model)))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(name), F.lit(1))), lambda p: (p == 1) | F.substring(name, p - 1, F.lit(1)).isin(*"/:@.-"))
    parts = ids.select(model, name.alias("_name"), F.explode(starts).alias("_at")).withColumn("_part", F.substring("_name", F.col("_at"), F.length("_name")))
    heads = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_part")) if lengths else F.expr("array()").cast("array<int>")
    heads = F.transform(heads, lambda n: F.substring(F.col("_part"), F.lit(1), n))
    met = parts.withColumn("_head", F.explode(heads)).join(known, "_head").where(((F.col("_at") == 1) | ~F.col("_whole")) & F.expr("rlike(_part, _re)"))
    best = met.groupBy(model).agg(F.min(F.struct("_wild", "place", "developer", "pattern")).alias("b"))
    return ids.join(best.withColumnRenamed(model, "_m"), F.col(model).eqNullSafe(F.col("_m")), "left").select(model, "b.developer", "b.pattern")
