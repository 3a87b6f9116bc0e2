"""SimHash near-dedup whose links are verified by the exact Jaccard similarity of word shingles, and completed.

First the SimHash fingerprints of the texts are linked by multi-index hashing;
each link is verified against the whole sets. A fingerprint's distance only
estimates the similarity, though, so pairs that the fingerprints leave apart are
then found by a prefix-filtered set join.

The shingles of all texts have one common order, frequent ones last. Of two sets
with similarity s or more, the first ``n - ceil(s * n) + 1`` shingles of each
share one, so texts that share such a shingle are the only candidates. Bounds
from the places of the shared shingle and from bitmaps of the sets rule out most
that aren't similar, never one that is; each other is verified against the whole
sets. Candidates are first verified against the
smallest text of their shingle; what that links, or fingerprints have linked, needs no more pairs within it.
The order decides how many candidates there are, never the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import forget_tables, keep_table, keyed_text
from .simhash import majority_bits, near_links

SEED = 42
#: Shingles are counted in one of so many texts; those in at least ``OFTEN`` of these go last, the ``MOST`` most frequent at most.
ONE_IN, OFTEN, MOST = 16, 4, 500_000
#: Bits of a set's bitmap: sets whose bitmaps differ in d bits differ in d shingles at least.
BITS = 2048
#: Fingerprints up to so many bits apart are linked first: four segments at radius one find all of these.
DISTANCE, SEGMENTS = 7, 4
#: Up to this many candidates' ids (counted) are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; a shorter text is one shingle, a blank one none."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[min(words, len(tokens)) - 1 :]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)], np.uint64)).view(np.int64)


def _bitmap(h: np.ndarray) -> np.ndarray:
    bits = np.zeros(BITS, np.uint8)
    bits[h.view(np.uint64) % np.uint64(BITS)] = 1
    return np.packbits(bits).view(np.int64)


def _digest(h: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)


def _frequent(source: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their place in the order."""

    def run(batches):
        forget_tables()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text, words))], names=["h"])

    some = source.where(F.pmod(F.xxhash64("id", "text"), F.lit(ONE_IN)) == 0).select("text").distinct()
    counts = some.mapInArrow(run, "h long").groupBy("h").count().where(F.col("count") >= OFTEN)
    rows = counts.orderBy(F.desc("count"), "h").limit(MOST).select("h").toPandas()["h"].to_numpy(np.int64)
    by_hash = np.argsort(rows)
    return rows[by_hash], -by_hash


def _sets(source: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, row_key, s0, s1, n, f0, bits, head): digest, size, SimHash and bitmap of each text's set, and its first shingles, which decide.

    Whole sets take more room than the texts; those of candidates are made again.
    """
    known, place = _frequent(source, words)

    def run(batches):
        forget_tables()
        for batch in batches:
            digests, sizes, prints, maps, heads = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, words)
                digests.append(_digest(h))
                n = len(h)
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    often = known[at] == h
                    h = np.concatenate([h[~often], h[often][np.argsort(place[at[often]], kind="stable")]])
                k = n - math.ceil(similarity * n - 1e-9) + 1 if n else 0
                sizes.append(n)
                prints.append(majority_bits(h.view(np.uint64)))
                maps.append(_bitmap(h))
                heads.append(h[:k])
            ids = np.array(digests, np.int64).reshape(-1, 2)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(sizes, pa.int32()), pa.array(prints, pa.int64()), pa.array(maps, longs), pa.array(heads, longs)],
                names=["id", "row_key", "s0", "s1", "n", "f0", "bits", "head"],
            )

    kind = source.schema["id"].dataType.simpleString()
    return source.select("id", "text", row_key(F.col("text")).alias("row_key")).mapInArrow(run, f"id {kind}, row_key long, s0 long, s1 long, n int, f0 long, bits array<long>, head array<long>")


def _few(pairs: DataFrame, name: str) -> DataFrame:
    """The nodes of ``pairs``, as the smaller side of a join."""
    ends = keep_table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), name)
    return F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends.hint("shuffle_hash")


def _verified(pairs: DataFrame, sets: DataFrame, source: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole sets are that similar."""
    some = keep_table(sets.select("node", "s0", "s1", "n", "bits").join(_few(pairs, "candidates"), "node", "left_semi"), "candidate-bits")
    small = lambda end: some.select(F.col("node").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"bits{end}")).hint("shuffle_merge")
    apart = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    # (n + n' - d) / 2 shingles at most are common
    most = F.floor((F.col("na") + F.col("nb") - apart) / 2)
    pairs = pairs.join(small("b"), "b").join(small("a"), "a").where(most / (F.col("na") + F.col("nb") - most) >= similarity)
    pairs = keep_table(pairs.select("a", "b").distinct(), "likely-pairs")

    def whole(batches):
        for batch in batches:
            made = [shingles(t, words) for t in batch.column(1).to_pylist()]
            digests = np.array([_digest(h) for h in made], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(made, pa.list_(pa.int64()))], names=["node", "s0", "s1", "s"])

    texts = source.where("id is not null").select(F.col("id").cast("long").alias("node"), "text").join(_few(pairs, "likely-nodes"), "node", "left_semi")
    held = texts.mapInArrow(whole, "node long, s0 long, s1 long, s array<long>")
    held = keep_table(held.join(some.select("node", "s0", "s1").hint("shuffle_hash"), ["node", "s0", "s1"], "left_semi").dropDuplicates(["node", "s0", "s1"]), "candidate-sets")
    of = lambda end: held.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")).hint("shuffle_merge")
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common / (F.size("sa") + F.size("sb") - common) >= similarity).select("a", "b").distinct()


def row_key(text: Column) -> Column:
    """What tells rows of one id apart in ``similar_groups``: a 64-bit hash of the text, null as empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def kept_rows(groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, row_key): of each group of ``similar_groups`` the row with the smallest id; of rows with that id, and of
    groups without any, the one with the smallest key."""
    own = groups.where(F.col(id_col).eqNullSafe(F.col("component_id")))
    kept = own.groupBy("group_id").agg(F.min(F.struct("row_key", id_col)).alias("k"))
    return kept.select(f"k.{id_col}", "k.row_key")


def similar_groups(docs: DataFrame, *, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, row_key, group_id, component_id.

    Texts whose sets of ``words``-word shingles have a Jaccard similarity of at
    least ``similarity`` are linked, all of them, and component_id is the
    smallest id reachable. Words are parted by ASCII white space, ASCII case
    doesn't count. Null and blank texts have the empty set and are equal to each
    other; rows that repeat an id are linked by their own texts, as are rows
    without one; component_id is null where no row of a group has an id. An empty
    table gives an empty result.
    """
    source = keyed_text(docs, id_col, text_col)
    odd = source.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 or id is null").select(F.col("id").alias("odd_id"))
    odd = keep_table(odd, "odd-ids")
    if odd.isEmpty():
        groups = _groups(source, words, similarity)
        return groups.select(F.col("id").alias(id_col), "row_key", F.col("root").alias("group_id"), F.col("root").alias("component_id"))
    # such rows stand under a number of their own: a hash of id and text, below zero
    own = F.when(F.col("is_odd"), F.xxhash64("id", "text").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("id").cast("long"))
    marked = source.join(odd.withColumn("is_odd", F.lit(True)), F.col("id").eqNullSafe(F.col("odd_id")), "left").withColumn("is_odd", F.coalesce("is_odd", F.lit(False)))
    marked = keep_table(marked.select(F.col("id").alias("own_id"), own.alias("id"), "text"), "numbered-rows")
    groups = keep_table(_groups(marked.select("id", "text"), words, similarity).distinct(), "numbered-groups")
    rows = marked.select("own_id", "id", row_key(F.col("text")).alias("row_key")).join(groups, ["id", "row_key"])
    least = rows.groupBy("root").agg(F.min("own_id").alias("component_id"))
    return rows.join(least, "root").select(F.col("own_id").alias(id_col), "row_key", F.col("root").alias("group_id"), "component_id")


def _groups(source: DataFrame, words: int, similarity: float) -> DataFrame:
    """(id, row_key, root) of each row of (id, text): equal ids have equal texts, none is null."""
    own = keep_table(_sets(source, words, similarity), "shingle-sets")
    nodes = keep_table(own.groupBy("s0", "s1").agg(F.min("id").cast("long").alias("node")), "shingle-nodes")
    named = nodes.where("node is not null").withColumnsRenamed({"s0": "n0", "s1": "n1"})
    one = (F.col("id") == F.col("node")) & (F.col("s0") == F.col("n0")) & (F.col("s1") == F.col("n1"))
    every = F.broadcast(named) if named.count() <= BROADCAST_IDS else named.hint("shuffle_merge")
    # one row for each node; repeated rows of it give the same keys and links
    keys = own.select("id", "s0", "s1", "n", "head").join(every, one).select("node", "n", F.posexplode("head").alias("at", "key"))
    by_key = Window.partitionBy("key")
    met = keys.withColumn("least", F.min(F.struct("node", "n", "at")).over(by_key)).withColumn("last", F.max("node").over(by_key))
    met = keep_table(met.where("least.node <> last").drop("last"), "shared-shingles")
    sets = own.join(every, one).select("node", "s0", "s1", "n", "bits")
    verified = lambda pairs: _verified(pairs, sets, source, words, similarity)

    # what SimHash links, by the least node of each fingerprint
    prints = own.where("n > 0").join(every, one).select("node", "f0").distinct()
    codes = keep_table(prints.groupBy("f0").agg(F.min("node").alias("node"), F.max("node").alias("last")), "fingerprints")
    equal = prints.join(codes.where("node <> last").select("f0", F.col("node").alias("a")), "f0").where("a <> node").select("a", F.col("node").alias("b"))
    near = near_links(codes.select("node", "f0"), distance=DISTANCE, segments=SEGMENTS)
    near = keep_table(verified(keep_table(near.union(equal).distinct(), "near-prints")), "near-links")
    linked = keep_table(components(near), "near-roots")
    of = lambda end: linked.select(F.col("node").alias(f"_{end}"), F.col("root").alias(f"{end}_root"))

    def alike(n, at, n2, at2):
        """Whether sets of n and n2 shingles, of which the first common ones have these places, can be so similar."""
        most = F.least(n - at, n2 - at2)
        return most / (n + n2 - most) >= similarity

    stars = met.where("least.node <> node").where(alike(F.col("least.n"), F.col("least.at"), F.col("n"), F.col("at")))
    stars = stars.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(of("a"), F.col("a") == F.col("_a"), "left").join(of("b"), F.col("b") == F.col("_b"), "left")
    stars = stars.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))  # the others are in one group already
    stars = keep_table(stars.select("a", "b"), "first-pairs")
    links = keep_table(near.union(verified(stars)), "first-links")
    roots = components(links)

    part = met.select("key", "node", "n", "at").distinct().join(roots, "node", "left").select("key", "node", "n", "at", F.coalesce("root", "node").alias("part"))
    parts = part.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    part = keep_table(part.join(parts, "key", "left_semi"), "open-shingles")
    others = part.select("key", F.col("part").alias("other")).distinct()
    left = part.join(others, "key").where("part < other")
    right = part.select("key", F.col("node").alias("node2"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("part").alias("other"))
    more = left.join(right, ["key", "other"]).where("node <> node2").where(alike(F.col("n"), F.col("at"), F.col("n2"), F.col("at2")))
    more = more.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = keep_table(more, "more-pairs")
    roots = components(links.union(verified(more)))

    classes = nodes.join(roots, "node", "left").select("s0", "s1", F.coalesce("root", "node").alias("root"))
    return own.select("id", "row_key", "s0", "s1").join(classes, ["s0", "s1"]).select("id", "row_key", "root")
