"""Removal of repeated byte strings with suffix arrays over anchored segments.

Every string of ``WINDOW`` bytes has an anchor: of its ``GRAM``-byte strings the
one with the smallest hash. Equal strings have equal anchors at equal places, so
only anchors that occur in more than one document matter, and strings need only
be compared with strings of the same anchor:

1. texts are stored in chunks in the shared folder; whole copies are found by digest;
2. each chunk sends the set of its anchors to buckets, which answer with one bit for each: in several documents or not;
3. each chunk sends the text around its repeated anchors (a segment) to buckets; a bucket builds the enhanced suffix array of
   its segments and scans the common-prefix intervals with a stack; those that are left-diverse are the maximal repeat groups,
   and each member whose document isn't the group's first is to be removed;
4. each chunk applies the answers to its texts.

Only anchors, segments around repeated anchors, and answers are shuffled; equal
segments of a chunk are sent once. Chunks are files of bounded size and buckets
are numbered by the corpus' size. All segments of one anchor are in one bucket:
copies of a passage shrink to one segment a chunk, but a bucket holds every
distinct surrounding of its anchors, about 300 bytes each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keep_table, keyed_text, shared_folder

WINDOW, GRAM = 50, 24
#: Bytes of text in one chunk, and bytes hashed at a time.
CHUNK_BYTES, STEP_BYTES = 8 << 20, 1 << 19
#: Bytes of corpus whose anchors make one bucket.
BUCKET_BYTES = 16 << 20
SIDE = WINDOW - GRAM
WIDTH = WINDOW + SIDE
#: About so many suffixes are put into one array; the segments of one anchor stay together.
ARRAY_ROWS = 100_000
NO_ID = (1 << 63) - 1
_HALF = np.uint64(0xFFFFFFFF00000000)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xCA5A826395121157)
    h ^= h >> np.uint64(32)
    return h


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place, built from hashes of 1, 2, 4, ... bytes."""
    with np.errstate(over="ignore"):
        size, power, part = 1, _BASE, data.astype(np.uint64) + np.uint64(1)
        parts = {1: (part, power)}
        while size * 2 <= GRAM:
            part = part[:-size] * power + part[size:]
            size, power = size * 2, power * power
            parts[size] = (part, power)
        whole, left = part, GRAM - size
        for n in sorted(parts, reverse=True):
            while n <= left:
                right, step = parts[n]
                right = right[GRAM - left :]
                whole = whole[: len(right)] * step + right[: len(whole)]
                left -= n
        return _mixed(whole[: len(data) - GRAM + 1])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last) of every anchor; strings with this anchor start at first..last. ``ends``: where documents end."""
    out = []
    begins = np.r_[0, ends[:-1]]
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + STEP_BYTES, "right")))
        lo, hi = int(begins[at]), int(ends[to - 1])
        if hi - lo >= WINDOW:
            h = _gram_hashes(data[lo:hi])
            least = (h & _HALF) | np.arange(len(h), dtype=np.uint64)
            size, span = 1, WINDOW - GRAM + 1
            while size * 2 <= span:
                least = np.minimum(least[:-size], least[size:])
                size *= 2
            if size < span:
                least = np.minimum(least[: size - span], least[span - size :])
            starts = np.arange(len(least))
            room = np.repeat(ends[at:to] - lo, (ends - begins)[at:to])[: len(least)]
            starts = starts[starts + WINDOW <= room]
            chosen = (least[starts] & ~_HALF).astype(np.int64)
            if len(chosen):
                cut = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)])
                last = np.r_[cut[1:], len(chosen)] - 1
                out.append((h[chosen[cut]], chosen[cut] + lo, starts[cut] + lo, starts[last] + lo))
        at = to
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _packed(a: np.ndarray) -> bytes:
    """Integers by byte planes of their differences; sorted ones shrink in the shuffle's compression."""
    a = np.ascontiguousarray(a).view(np.uint64)
    return np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


# --- chunks ---------------------------------------------------------------------------------


def _fs(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def _copies(text: bytes | None) -> np.ndarray:
    """Row numbers from their list."""
    return np.array([int(x) for x in text.split(b",")] if text else [], np.int32)


class Chunk:
    """A stored chunk without its whole copies."""

    def __init__(self, folder: str, name: str, copies: np.ndarray):
        fs, base = _fs(folder)
        with fs.open_input_file(f"{base}/{name}") as f:
            table = pa.ipc.open_file(f).read_all().combine_chunks()
        self.ids = table.column("id").to_numpy()
        text = table.column("text").chunk(0) if table.num_rows else pa.array([], pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        self.data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] is not None else np.zeros(0, np.uint8)
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[copies] = True
        self.begins, self.ends = offsets[:-1], offsets[1:]

    def anchors(self):
        """Anchors of the texts that aren't copies, with the row of each."""
        found = []
        own = np.flatnonzero(~self.copy)
        if len(own):
            for run in np.split(own, np.flatnonzero(np.diff(own) != 1) + 1):
                lo = int(self.begins[run[0]])
                h, *places = anchors(self.data[lo : int(self.ends[run[-1]])], self.ends[run] - lo)
                found.append((h, *(p + lo for p in places)))
        if not found:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))
        h, place, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        return h, place, first, last, np.searchsorted(self.ends, place, "right")


def _store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the texts in chunks; (chunk, row, id, bytes, digest) per document."""

    def write(fs, base, parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        name = f"{uuid.uuid4().hex}.arrow"
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/{name}") as out, pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
            writer.write_table(table)
        text = table.column("text").chunk(0)
        digests = [hashlib.blake2b(x.as_buffer(), digest_size=16).digest() for x in text]
        lengths = np.diff(np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1])
        columns = [pa.array([name] * len(text)), pa.array(np.arange(len(text), dtype=np.int32)), table.column("id").chunk(0), pa.array(lengths), pa.array(digests, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "row", "id", "bytes", "digest"])

    def run(batches):
        fs, base = _fs(folder)
        parts, size = [], 0
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column(0).fill_null(NO_ID), batch.column(1).cast(pa.large_binary())], names=["id", "text"])
            offsets = np.frombuffer(whole.column(1).buffers()[1], np.int64)[whole.column(1).offset : whole.column(1).offset + len(whole) + 1]
            at = 0
            while at < len(whole):  # as many rows as the chunk still has room for, at least one
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES - size, "right")) - 1)
                parts.append(whole.slice(at, to - at))
                size += int(offsets[to] - offsets[at])
                at = to
                if size >= CHUNK_BYTES or at < len(whole):
                    yield write(fs, base, parts)
                    parts, size = [], 0
        if parts:
            yield write(fs, base, parts)

    return keep_table(docs.mapInArrow(run, "chunk string, row int, id long, bytes long, digest binary"), "chunk-rows")


def _groups(batches, key: int):
    """Rows of partitions sorted by column ``key``, gathered by it."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[key] != now:
                yield now, rows
                rows = []
            now = row[key]
            rows.append(row)
    if rows:
        yield now, rows


def _batch(rows: list[tuple], schema: str):
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


# --- step 2: which anchors are in several documents -------------------------------------------

SETS = "bucket int, chunk string, hashes binary, several binary"
ANSWERS = "chunk string, bucket int, bits binary"


def _by_bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct anchors, and whether several rows have each."""
    order = np.argsort(h, kind="stable")
    s, r = h[order], row[order]
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    if not len(first):
        return s, np.zeros(0, bool)
    return s[first], np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)


def _send_sets(folder: str, buckets: int):
    def run(batches):
        for name, rows in _groups(batches, 0):
            h, _, _, _, row = Chunk(folder, name, _copies(rows[0][2])).anchors()
            h, several = _distinct(_spread(h), row)
            cuts = np.searchsorted(_by_bucket(h, buckets), np.arange(buckets + 1))
            out = [(b, name, _packed(h[x:y]), np.packbits(several[x:y]).tobytes()) for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
            if out:
                yield _batch(out, SETS)

    return run


def _spread(h: np.ndarray) -> np.ndarray:
    """Anchors are minima, so their hashes crowd at the low end; mixed again they fill the buckets evenly (one to one)."""
    with np.errstate(over="ignore"):
        return _mixed(h * np.uint64(0x9FB21C651E98DF25))


def _answer_sets(batches):
    for bucket, rows in _groups(batches, 0):
        sets = [_unpacked(r[2]) for r in rows]
        several = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(s)).astype(bool) for r, s in zip(rows, sets, strict=True)]
        every = np.sort(np.concatenate(sets))
        twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *(s[m] for s, m in zip(sets, several, strict=True))]))
        del every
        out = []
        for r, s in zip(rows, sets, strict=True):
            at = np.minimum(np.searchsorted(twice, s), max(len(twice) - 1, 0))
            out.append((r[1], bucket, np.packbits(twice[at] == s if len(twice) else np.zeros(len(s), bool)).tobytes()))
        yield _batch(out, ANSWERS)


# --- step 3: segments around repeated anchors ---------------------------------------------------

SEGMENTS = "bucket int, chunk string, ids binary, starts binary, shape binary, which binary, texts binary"
REMOVALS = "chunk string, bucket int, bits binary"


def _send_segments(folder: str, buckets: int):
    def run(batches):
        for name, rows in _groups(batches, 0):
            rows = {r[1]: r[2] for r in rows}
            chunk = Chunk(folder, name, _copies(rows.pop(-1)))
            h, place, first, last, row = chunk.anchors()
            h = _spread(h)
            known, _ = _distinct(h, row)
            bucket_of = _by_bucket(known, buckets)
            flags = np.zeros(len(known), bool)
            for b, bits in rows.items():
                x, y = np.searchsorted(bucket_of, [b, b + 1])
                flags[x:y] = np.unpackbits(np.frombuffer(bits, np.uint8), count=y - x)
            use = flags[np.searchsorted(known, h)] if len(known) else np.zeros(0, bool)
            h, place, first, last, row = h[use], place[use], first[use], last[use], row[use]
            bucket = _by_bucket(h, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if y > x:
                    o = order[x:y]
                    matrix = _matrix(chunk.data, place[o], first[o], last[o])
                    shape = ((place[o] - first[o]) | ((last[o] - first[o]) << 8)).astype(np.uint16)
                    one, which = _same_rows(matrix, shape)
                    # the texts of the distinct segments, without the margins
                    columns = np.arange(WIDTH)[None, :]
                    lead = SIDE - (shape[one] & 255).astype(np.int64)
                    size = WINDOW + (shape[one] >> 8).astype(np.int64)
                    text = matrix[one][(columns >= lead[:, None]) & (columns < (lead + size)[:, None])]
                    yield _batch(
                        [(b, name, zlib.compress(_packed(chunk.ids[row[o]]), 1), _packed(first[o]), shape[one].tobytes(), which.astype(np.uint32).tobytes(), zlib.compress(text.tobytes(), 1))],
                        SEGMENTS,
                    )

    return run


def _matrix(data, place, first, last) -> np.ndarray:
    """Segments as rows with their anchors in the same columns; zero beyond their ends."""
    at = place[:, None] - SIDE + np.arange(WIDTH)[None, :]
    inside = (at >= first[:, None]) & (at < (last + WINDOW)[:, None])
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8)


def _same_rows(matrix: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the distinct rows, and for each row the number of its equal among them."""
    wide = np.zeros((len(matrix), -(-(WIDTH + 2) // 8) * 8), np.uint8)
    wide[:, :WIDTH] = matrix
    wide[:, WIDTH : WIDTH + 2] = shape.view(np.uint8).reshape(-1, 2)
    words = wide.view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(len(words), np.uint64)
        for k in range(words.shape[1]):
            key = _mixed((key ^ words[:, k]) * _BASE + np.uint64(k))
    _, one, which = np.unique(key, return_index=True, return_inverse=True)
    if not np.array_equal(words[one[which]], words):  # two rows with one hash
        _, one, which = np.unique(wide.view(np.dtype((np.void, wide.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return one, which.ravel()


def repeat_groups(order: np.ndarray, common: np.ndarray, left: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeat groups (begin, end, length) of an enhanced suffix array.

    ``order`` lists suffixes in order, ``common[i]`` is the common prefix of
    suffixes i - 1 and i of it, ``left`` the byte before each suffix (negative:
    a text's start, unlike any other). A stack holds the open common-prefix
    intervals of at least ``least``; one that closes is a group, order[begin:end],
    if the bytes to its left differ.
    """
    begins, ends, lengths = [], [], []
    before = left[order].tolist()
    heights = common.tolist()
    stack: list[list] = []  # [length, begin, byte to the left, or None once they differ]
    n = len(before)
    for i in range(1, n + 1):
        height = heights[i] if i < n else 0
        if height < least:
            height = 0
        begin, byte = i - 1, before[i - 1]
        byte = None if byte < 0 else byte
        if stack:
            top = stack[-1]
            if top[2] is not None and top[2] != byte:
                top[2] = None
        while stack and stack[-1][0] > height:
            length, start, seen = stack.pop()
            if seen is None:
                begins.append(start)
                ends.append(i)
                lengths.append(length)
            begin = start
            byte = seen
            if stack and stack[-1][2] is not None and stack[-1][2] != seen:
                stack[-1][2] = None
        if height and (not stack or stack[-1][0] < height):
            stack.append([height, begin, byte])
    return np.array(begins, np.int64), np.array(ends, np.int64), np.array(lengths, np.int64)


def _first_documents(matrix: np.ndarray, shape: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each segment and string in it, the smallest document id that has the string.

    ``owner`` is the smallest id with each whole segment.
    """
    lead, count = SIDE - (shape & 255).astype(np.int64), (shape >> 8).astype(np.int64) + 1
    first = np.repeat(owner[:, None], SIDE + 1, axis=1)
    gram = np.ascontiguousarray(matrix[:, SIDE:WINDOW]).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(len(gram), np.uint64)
        for k in range(gram.shape[1]):
            key = _mixed((key ^ gram[:, k]) * _BASE + np.uint64(k))
    _, which, sizes = np.unique(key, return_inverse=True, return_counts=True)
    which = which.ravel()
    shared = np.flatnonzero(sizes[which] > 1)  # the others have their anchor to themselves
    shared = shared[np.argsort(which[shared], kind="stable")]
    # Whole anchors go together into arrays of about ARRAY_ROWS suffixes.
    heads = np.flatnonzero(np.r_[True, which[shared][1:] != which[shared][:-1]]) if len(shared) else shared
    before = np.r_[0, np.cumsum(count[shared])]
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(before[heads], before[heads[at]] + ARRAY_ROWS)))
        _scan_segments(matrix, lead, count, owner, first, shared[heads[at] : heads[to] if to < len(heads) else None])
        at = to
    return first


def _scan_segments(matrix, lead, count, owner, first, shared) -> None:
    """Put the groups of the ``shared`` segments' strings into ``first``."""
    seg = np.repeat(shared, count[shared])
    string = np.arange(len(seg)) - np.repeat(np.cumsum(count[shared]) - count[shared], count[shared])
    start = lead[seg] + string
    end = lead[seg] + count[seg] + WINDOW - 1
    flat = np.zeros((len(seg), 80), np.uint8)
    columns = start[:, None] + np.arange(WIDTH)[None, :]
    flat[:, :WIDTH] = np.where(columns < end[:, None], matrix[seg[:, None], np.minimum(columns, WIDTH - 1)], 0)
    words = flat.view(np.dtype(">u8")).astype(np.uint64)
    order = np.lexsort(tuple(words[:, k] for k in range(words.shape[1] - 1, -1, -1)))
    del words
    flat, size = flat[order], (end - start)[order]
    differs = flat[1:] != flat[:-1]
    common = np.zeros(len(order), np.int64)
    common[1:] = np.where(differs.any(1), differs.argmax(1), 80)
    common[1:] = np.minimum(common[1:], np.minimum(size[1:], size[:-1]))
    left = np.where(string > 0, matrix[seg, np.maximum(start - 1, 0)].astype(np.int64), -1)
    begins, ends, lengths = repeat_groups(order, common, left, WINDOW)
    for b, e, n in zip(begins.tolist(), ends.tolist(), lengths.tolist(), strict=True):
        members = order[b:e]
        segs, at = seg[members], string[members]
        least = owner[segs].min()
        for k in range(n - WINDOW + 1):
            first[segs, at + k] = np.minimum(first[segs, at + k], least)


def _answer_segments(batches):
    for bucket, rows in _groups(batches, 0):
        ids, which, shapes, texts, base = [], [], [], [], 0
        for r in rows:
            ids.append(_unpacked(zlib.decompress(r[2])).astype(np.int64))
            shapes.append(np.frombuffer(r[4], np.uint16))
            which.append(np.frombuffer(r[5], np.uint32).astype(np.int64) + base)
            texts.append(np.frombuffer(zlib.decompress(r[6]), np.uint8))
            base += len(shapes[-1])
        shape, text = np.concatenate(shapes), np.concatenate(texts)
        size = WINDOW + (shape >> 8).astype(np.int64)
        lead = SIDE - (shape & 255).astype(np.int64)
        matrix = np.zeros((len(shape), WIDTH), np.uint8)
        columns = np.arange(WIDTH)[None, :]
        matrix[(columns >= lead[:, None]) & (columns < (lead + size)[:, None])] = text
        del text, texts
        one, same = _same_rows(matrix, shape)
        doc, segment = np.concatenate(ids), same[np.concatenate(which)]
        owner = np.full(len(one), NO_ID, np.int64)
        np.minimum.at(owner, segment, doc)
        first = _first_documents(matrix[one], shape[one], owner)
        count = (shape[one] >> 8).astype(np.int64) + 1
        out, at = [], 0
        for r, i in zip(rows, ids, strict=True):
            mine = slice(at, at + len(i))
            at += len(i)
            starts = _unpacked(r[3]).astype(np.int64)
            for x in range(0, len(i), 200_000):
                part = segment[mine][x : x + 200_000]
                later = (doc[mine][x : x + 200_000, None] > first[part]) & (np.arange(SIDE + 1)[None, :] < count[part][:, None])
                s, k = np.nonzero(later)
                if len(s):
                    out.append((r[1], bucket, _packed(np.sort(starts[x : x + 200_000][s] + k))))
        if out:
            yield _batch(out, REMOVALS)


# --- step 4 -------------------------------------------------------------------------------------

RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(folder: str, with_text: bool):
    def run(batches):
        for name, rows in _groups(batches, 0):
            copies = next(r[2] for r in rows if r[1] == -1)
            chunk = Chunk(folder, name, _copies(copies))
            edge = np.zeros(len(chunk.data) + 1, np.int32)
            for r in rows:
                if r[1] >= 0:
                    starts = _unpacked(r[2]).astype(np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + WINDOW, -1)
            gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
            out, kept_texts = [], []
            for k, (id_, lo, hi, copy) in enumerate(zip(chunk.ids.tolist(), chunk.begins.tolist(), chunk.ends.tolist(), chunk.copy.tolist(), strict=True)):
                bytes_, mask = chunk.data[lo:hi], gone[lo:hi]
                if copy:
                    removed, spans, kept = hi - lo, 1, b""
                elif mask.any():
                    removed, spans = int(mask.sum()), int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                    kept = bytes_[~mask].tobytes()
                else:
                    removed, spans, kept = 0, 0, bytes_.tobytes()
                out.append((None if id_ == NO_ID else id_, hi - lo, removed, spans, hashlib.sha256(kept).hexdigest()) + ((kept,) if with_text else ()))
            if out:
                yield _batch(out, RESULT + ", kept binary" * with_text)

    return run


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: ``id_col``, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes).

    Each byte that lies in a string of ``WINDOW`` bytes which also starts in a
    document with a smaller id is removed; strings are judged on the input and
    never cross documents. Ids are integers; rows without one come last. Rows
    with one id never remove one another. Null texts are empty; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/repeat-chunks-{uuid.uuid4().hex}"
    source = keyed_text(docs, id_col, text_col).select(F.col("id").cast("long").alias("id"), "text")
    rows = _store(source, folder)
    size = rows.agg(F.countDistinct("chunk").alias("chunks"), F.sum("bytes").alias("bytes")).first()
    chunks, buckets = max(1, size["chunks"]), max(4, -(-(size["bytes"] or 0) // BUCKET_BYTES))
    firsts = rows.where(f"bytes >= {WINDOW}").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    firsts = keep_table(firsts, "copied-texts")  # read back, so that Spark can split a hot text's rows in the join
    copies = rows.join(firsts, "digest").where("id > first").groupBy("chunk").agg(F.collect_list("row").alias("rows"))
    packed = lambda c: F.encode(F.array_join(F.sort_array(c), ","), "UTF-8")
    chunk_list = keep_table(rows.select("chunk").distinct().join(copies, "chunk", "left").select("chunk", F.lit(-1).alias("bucket"), packed("rows").alias("bits")), "chunks")

    by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "chunk")
    by_chunk = lambda df: df.union(chunk_list).repartition(chunks, "chunk").sortWithinPartitions("chunk", "bucket")

    sets = chunk_list.repartition(chunks).mapInArrow(_send_sets(folder, buckets), SETS)
    answers = by_bucket(sets).mapInArrow(_answer_sets, ANSWERS)
    segments = by_chunk(answers).mapInArrow(_send_segments(folder, buckets), SEGMENTS)
    removals = by_bucket(segments).mapInArrow(_answer_segments, REMOVALS)
    done = by_chunk(removals).mapInArrow(_apply(folder, with_text), RESULT + ", kept binary" * with_text)
    return done.withColumnRenamed("id", id_col)
