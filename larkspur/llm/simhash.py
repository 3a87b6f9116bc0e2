"""SimHash near-duplicates with multi-index hashing.

Fingerprints are grouped first, so copies count once. A fingerprint is cut into
segments. It is put into a table under each segment's value and under the values
reached by clearing one set bit of it; two fingerprints one bit apart in a
segment therefore meet, as one of them has the bit set. What meets is verified
by complete distance. Of two fingerprints at most ``2 * segments - 1`` bits apart
some segment differs in at most one bit, so these are all found; pairs further
apart are found as often as one of their segments is that close.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, keep_table, keyed_text, prepare

SEED = 42
#: A table entry with more fingerprints is cut into blocks of this many, and each two blocks are compared.
BLOCK = 8192
#: Up to this many fingerprints of an entry are compared by shifting, more by a search from each one.
FEW = 32
#: Shingles hashed at a time.
STEP = 200_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def _lane(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of a shingle: XXH64 itself, then mixtures of it."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def majority_bits(h: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, as a signed integer."""
    if not len(h):
        return 0
    planes = h.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    counts = (np.bincount(planes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, words: int = 4, lanes: int = 1) -> list[int]:
    """SimHash of the ``words``-word shingles of a whole text: 64 bits a lane, each as a signed integer."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return [0] * lanes
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.zeros(len(tokens), np.int64)
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    width = min(words, len(tokens))
    ends = (starts + lengths)[width - 1 :]
    n = len(ends)
    counts = np.zeros((lanes, 64), np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        pairs = zip(starts[at : min(n, at + STEP)].tolist(), ends[at : at + STEP].tolist(), strict=True)
        h = np.array([hashed(joined[a:b], SEED) for a, b in pairs], np.uint64)
        for k in range(lanes):
            planes = _lane(h, k).view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
            counts[k] += (np.bincount(planes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    values = [sum(1 << b for b in np.flatnonzero(2 * c > n).tolist()) for c in counts]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def fingerprints(docs: DataFrame, *, words: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1, ...: long) for each row; null and blank texts have fingerprint 0."""
    source = keyed_text(docs, id_col, text_col)
    names = [f"f{k}" for k in range(lanes)]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, words, lanes) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(fp[:, k]) for k in range(lanes))], names=["id", *names])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def _probes(nodes: DataFrame, segments: int, lanes: int) -> DataFrame:
    """(key, node, f0, ...) for every segment's value and for it with one set bit cleared."""
    per_lane = segments // lanes
    edges = [64 * k // per_lane for k in range(per_lane + 1)]
    rows = []
    for lane in range(lanes):
        for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
            value = f"(shiftrightunsigned(f{lane}, {lo}) & {(1 << (hi - lo)) - 1}L)"
            key = f"({lane * per_lane + k} * shiftleft(1L, 56) + %s)"
            rows.append(f"array({key % value})")
            rows.append(f"transform(filter(sequence(0, {hi - lo - 1}), b -> ({value} & shiftleft(1L, b)) <> 0), b -> {key % f'({value} - shiftleft(1L, b))'})")
    return nodes.select(F.explode(F.expr(f"concat({', '.join(rows)})")).alias("key"), "node", *[f"f{k}" for k in range(lanes)])


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _search(node: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each connected group: a search from each reached fingerprint over those not yet reached."""
    left, right = [], []
    rest = np.arange(len(node))
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = _apart(fp[rest], fp[one]) <= distance
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node[one]))
                right.append(node[found])
                queue.extend(found.tolist())
                rest = rest[~near]
    if not left:
        return node[:0], node[:0]
    return np.concatenate(left), np.concatenate(right)


def _solve(key: np.ndarray, node: np.ndarray, fp: np.ndarray, distance: int):
    """Links within whole table entries, given in order of their keys."""
    sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)]) if len(key) else np.zeros(0, np.int64)
    starts = np.cumsum(sizes) - sizes
    for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
        yield _search(node[s : s + n], fp[s : s + n], distance)
    few = np.repeat(sizes <= FEW, sizes)
    key, node, fp = key[few], node[few], fp[few]
    for lag in range(1, FEW):
        same = np.flatnonzero(key[lag:] == key[:-lag])
        if not len(same):
            break
        near = same[_apart(fp[same], fp[same + lag]) <= distance]
        yield node[near], node[near + lag]


def _gathered(batches, rows: int = 50_000):
    """Lists of batches of about ``rows`` rows."""
    part, n = [], 0
    for batch in batches:
        part.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield part
            part, n = [], 0
    if part:
        yield part


def _entries(distance: int, lanes: int, split: bool = True):
    """For partitions sorted by key: rows (0, a, b, ...) are links of nodes; with ``split``, rows (1, key, block, node,
    f0, ...) are those of entries over ``BLOCK``, of which only as much is held."""

    def links(a, b):
        zero = pa.array(np.zeros(len(a), np.int64))
        return emit(0, pa.array(a), pa.array(b), zero, *[zero] * lanes)

    def emit(kind, *columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *columns], names=["kind", "a", "b", "node", *(f"f{k}" for k in range(lanes))])

    def on(key, block, node, fp):
        return emit(1, pa.array(key), pa.array(block), pa.array(node), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(lanes)))

    def run(batches):
        key = node = np.zeros(0, np.int64)
        fp = np.zeros((0, lanes), np.int64)
        large, sent = None, 0  # the key of the entry that is too large, how many of its rows went on
        for part in _gathered(batches):
            cols = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in part]) for k in range(2 + lanes)]
            key, node = np.concatenate([key, cols[0]]), np.concatenate([node, cols[1]])
            fp = np.concatenate([fp, np.stack(cols[2:], axis=1)])
            if large is not None:
                n = int(np.searchsorted(key, large, "right"))
                if n:
                    yield on(key[:n], (sent + np.arange(n)) // BLOCK, node[:n], fp[:n])
                    sent, key, node, fp = sent + n, key[n:], node[n:], fp[n:]
            if not len(key):
                continue
            large = None
            last = int(np.searchsorted(key, key[-1], "left"))
            for a, b in _solve(key[:last], node[:last], fp[:last], distance):
                if len(a):
                    yield links(a, b)
            key, node, fp = key[last:], node[last:], fp[last:]
            if split and len(key) > BLOCK:
                large, sent = key[0], len(key)
                yield on(key, np.arange(sent) // BLOCK, node, fp)
                key, node, fp = key[:0], node[:0], fp[:0]
        for a, b in _solve(key, node, fp, distance):
            if len(a):
                yield links(a, b)

    return run


def near_links(nodes: DataFrame, *, distance: int = 4, segments: int = 3, lanes: int = 1) -> DataFrame:
    """Nodes with distinct fingerprints (node, f0, ...) -> links (a, b) between nodes within ``distance`` bits.

    Of what meets, every two within the distance end up in one connected group
    of the links; inside a large table entry only links that join its groups
    are given.
    """
    if segments % lanes:
        raise ValueError("each lane takes the same number of segments")
    prepare(nodes.sparkSession)
    schema = "kind int, a long, b long, node long, " + ", ".join(f"f{k} long" for k in range(lanes))
    met = _probes(nodes.where("node is not null"), segments, lanes)
    found = cut(met.repartition("key").sortWithinPartitions("key").mapInArrow(_entries(distance, lanes), schema))
    links = found.where("kind = 0").select("a", "b")
    large = found.where("kind = 1").withColumnsRenamed({"a": "key", "b": "block"}).drop("kind")
    if not large.isEmpty():
        last = large.groupBy("key").agg(F.max("block").alias("last"))
        blocks = F.expr("transform(sequence(0, last), x -> xxhash64(key, least(x, block), greatest(x, block)))")
        pairs = large.join(last, "key").select(F.explode(blocks).alias("key"), "node", *[f"f{k}" for k in range(lanes)])
        more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_entries(distance, lanes, split=False), schema)
        links = links.union(more.select("a", "b"))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def estimated_distance(similarity: float, lanes: int) -> int:
    """Bits between fingerprints of texts whose shingle sets have that Jaccard similarity: the angle of their cosine 2s / (1 + s)."""
    return int(64 * lanes * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def near_duplicates(
    docs: DataFrame, *, words: int = 4, distance: int = 4, segments: int = 3, lanes: int = 1, similarity: float | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: ``id_col``, fingerprint (16 hex digits a lane), component_id.

    Fingerprints at most ``distance`` bits apart are linked, and component_id is
    the smallest id reachable. Null and blank texts have fingerprint zero and
    link like any other; rows without an id get their fingerprint's component
    (null if all its rows lack one); repeated rows are kept; other columns are
    ignored; an empty table gives an empty result.

    With ``similarity`` the links are the texts whose sets of shingles have that
    Jaccard similarity or more, whatever their fingerprints' distance: those that
    SimHash links are verified, and completed to all of them (``set_join``);
    the result is then that of ``set_join.similar_groups``.
    """
    if similarity is not None:
        from .set_join import similar_groups

        return similar_groups(docs, words=words, similarity=similarity, id_col=id_col, text_col=text_col)
    lane = [f"f{k}" for k in range(lanes)]
    own = keep_table(fingerprints(docs, words=words, lanes=lanes, id_col=id_col, text_col=text_col), "fingerprints")
    nodes = own.groupBy(*lane).agg(F.min("id").cast("long").alias("node"))
    roots = components(near_links(nodes, distance=distance, segments=segments, lanes=lanes))
    classes = nodes.join(roots, "node", "left").select(*lane, F.coalesce("root", "node").alias("component_id"))
    shown = F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in lane])
    return own.join(classes, lane).select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")
