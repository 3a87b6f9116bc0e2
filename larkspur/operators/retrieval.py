"""Lexical, dense and hybrid top-k within a scope, and near-duplicate vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.unicode_forms import fold_token
from ..shipping import prepare, ship


_WORD, _CJK = r"[\p{L}\p{M}\p{Nd}]", r"[\p{Han}\p{Hangul}\u3040-\u30ff\u31f0-\u31ff]"
_RUNS = regex.compile(rf"[{_WORD}&&{_CJK}]+|[{_WORD}--{_CJK}]+", regex.V1)
_IS_CJK = regex.compile(_CJK)


def word_tokens(text: str) -> list[str]:
    """Distinct words of letters, marks and digits; runs of Han, kana and Hangul give character pairs.

    Width forms count as the plain ones (half-width katakana too), case is folded, accents are composed.
    """
    out: dict[str, None] = {}
    for run in _RUNS.findall(fold_token(text)):
        if len(run) > 1 and _IS_CJK.match(run):
            out.update(dict.fromkeys(map("".join, zip(run, run[1:], strict=False))))
        else:
            out[run] = None
    return list(out)


def _is_ascii(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x00-\x7f]")


def _ascii_tokens(text: Column) -> Column:
    """The tokens of an ASCII text; null of others."""
    return F.when(_is_ascii(text), F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))))


def tokens(text: Column) -> Column:
    """The tokens of ``word_tokens``, as an array: of ASCII texts by expressions, of others over Arrow."""

    @F.arrow_udf("array<string>")
    def other(texts: pa.Array) -> pa.Array:
        made = lambda part: pa.array([None if t is None else word_tokens(t) for t in part.to_pylist()], pa.list_(pa.string()))
        parts = [made(texts.slice(at, PIECE)) for at in range(0, len(texts), PIECE)]  # Python strings of a piece only
        return pa.concat_arrays(parts) if parts else made(texts)

    return F.coalesce(_ascii_tokens(text), other(F.when(~_is_ascii(text), text)))


def cosine(a: Column, b: Column) -> Column:
    """0 for a missing vector, another length or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def _top(df: DataFrame, query: str, doc: str, score: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.col(score).desc(), F.col(doc).asc()))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


#: Queries that are sent to every task at a time, and their tokens (both counted); more are asked in several blocks.
QUERY_BLOCK, BLOCK_TOKENS = 4096, 2_000_000
#: Pairs of document and query that a task scores at a time.
CELLS = 500_000
#: Texts that a task has as Python values at a time.
PIECE = 64


def _query_blocks(queries: DataFrame) -> Iterator[pa.Table]:
    """The queries' rows in blocks of about ``QUERY_BLOCK`` and ``BLOCK_TOKENS``, one block at a time."""
    rows, words = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("_t")), F.lit(0))).first()
    n = max(1, -(-rows // QUERY_BLOCK), -(-words // BLOCK_TOKENS))
    for k in range(n):
        yield (queries if n == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k)).toArrow()


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _lists(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A list column's items, and where each row's begin and end in them."""
    return column.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _vectors(column: pa.Array) -> list[np.ndarray]:
    """Rows of a list of doubles; empty where there is none."""
    items, ends = _lists(column)
    items = items.to_numpy(zero_copy_only=False)
    return [items[a:b] for a, b in zip(ends, ends[1:], strict=False)]


class _Asked:
    """The queries of one block and scope: an inverted list from the block's token numbers to queries, and their vectors by length."""

    def __init__(self, ids: list, tokens: list[np.ndarray], vectors: list[np.ndarray] | None):
        self.ids = ids
        counts = [len(t) for t in tokens]
        every = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
        order = np.argsort(every, kind="stable")
        self.kinds, starts = np.unique(every[order], return_index=True)
        self.starts = np.append(starts, len(every))
        self.queries = np.repeat(np.arange(len(ids), dtype=np.int32), counts)[order]
        by_length: dict[int, tuple[list[int], list]] = {}
        for i, v in enumerate(vectors or ()):
            if len(v) and (norm := float(np.linalg.norm(v))) > 0:
                at, own = by_length.setdefault(len(v), ([], []))
                at.append(i)
                own.append(np.asarray(v, float) / norm)
        self.vectors = {n: (np.array(at), np.stack(own)) for n, (at, own) in by_length.items()}

    def overlaps(self, texts: list) -> np.ndarray:
        """Shared tokens of each text (token numbers) and query: each is looked up once, whatever the number of queries."""
        out = np.zeros((len(texts), len(self.ids)), np.int64)
        if not len(self.kinds):
            return out
        for row, own in enumerate(texts):
            at = np.searchsorted(self.kinds, own)
            at = at[self.kinds[np.minimum(at, len(self.kinds) - 1)] == own]
            if len(at):
                hit = [self.queries[a:b] for a, b in zip(self.starts[at].tolist(), self.starts[at + 1].tolist(), strict=True)]
                out[row] = np.bincount(np.concatenate(hit), minlength=len(self.ids))
        return out

    def cosines(self, vectors: list) -> np.ndarray:
        """0 for a missing vector, another length or a zero norm."""
        out = np.zeros((len(vectors), len(self.ids)))
        lengths = np.array([len(v) for v in vectors])
        for n, (at, matrix) in self.vectors.items():
            rows = np.flatnonzero(lengths == n)
            if len(rows):
                own = np.array([vectors[r] for r in rows], float)
                norms = np.linalg.norm(own, axis=1, keepdims=True)
                out[np.ix_(rows, at)] = np.divide(own, norms, out=np.zeros_like(own), where=norms > 0) @ matrix.T
        return out


class _Best:
    """The ``k`` best documents of each query so far, by falling score, then by document."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]
        self.least = np.full(n, -np.inf)

    def add(self, docs: list, scores: np.ndarray) -> None:
        """``docs`` are in order; scores of -inf don't count."""
        k = self.k
        if len(docs) > k:  # equal scores stay in the documents' order
            top = np.argsort(-scores, axis=0, kind="stable")[:k]
        else:
            top = np.repeat(np.arange(len(docs))[:, None], scores.shape[1], 1)
        found = np.take_along_axis(scores, top, 0)
        for place, q in np.argwhere((found > -np.inf) & (found >= self.least)):
            self.rows[q].append((-found[place, q], docs[top[place, q]]))
        for q in np.unique(np.argwhere((found > -np.inf) & (found >= self.least))[:, 1]):
            self.rows[q] = sorted(self.rows[q])[:k]
            if len(self.rows[q]) == k:
                self.least[q] = -self.rows[q][-1][0]


def _searched(docs: DataFrame, scope: Sequence[str]) -> list[Column]:
    """A document's columns for ``_scored``: ASCII texts as tokens, others as they are."""
    return [F.col("doc_id"), *map(F.col, scope), _ascii_tokens(F.col("text")).alias("_t"), F.when(~_is_ascii(F.col("text")), F.col("text")).alias("_o")]


def _scored(docs: DataFrame, asked: pa.Table, scope: Sequence[str], out: str, use, ended):
    """Each task's documents against the block's queries of their scope; ``use(state, scope, asked, ids, texts, vectors)`` sees
    them in pieces, in the order of the ids, ``ended(state)`` gives a task's rows.

    Tokens are numbered within the block; a document's tokens stay in Arrow until they are numbers, and those that no query
    has are dropped there. A task holds one block of queries, as arrays, and one or two Arrow batches (``shipping.prepare``);
    at most ``PIECE`` documents are Python values at a time.
    """
    n_scope, with_vector = len(scope), "_v" in docs.columns
    items, ends = _lists(_whole(asked["_t"]))
    coded = items.dictionary_encode()
    numbers, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    vectors = _vectors(_whole(asked["_v"])) if "_v" in asked.column_names else None
    ids, groups = asked["query_id"].to_pylist(), {}
    for row, key in enumerate(zip(*[asked[c].to_pylist() for c in scope], strict=True) if n_scope else [()] * len(ids)):
        groups.setdefault(key, []).append(row)
    made = {key: _Asked([ids[r] for r in rows], [numbers[ends[r] : ends[r + 1]] for r in rows], vectors and [vectors[r] for r in rows]) for key, rows in groups.items()}
    spark = docs.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast((made, vocabulary))

    def run(batches):
        (known, words), state = shared.value, {}

        def numbered(plain: pa.Array, other: pa.Array) -> list[np.ndarray]:
            items, ends = _lists(plain)
            rows = np.flatnonzero(pc.is_valid(other).to_numpy(zero_copy_only=False))
            more = [pa.array(word_tokens(other[int(row)].as_py()), items.type) for row in rows]
            found = pc.fill_null(pc.index_in(pa.concat_arrays([items, *more]), value_set=words), -1).to_numpy(zero_copy_only=False)
            made = np.split(found[: len(items)], ends[1:-1])
            for row, own in zip(rows, np.split(found[len(items) :], np.cumsum([len(m) for m in more])[:-1]), strict=False):
                made[row] = own
            return [own[own >= 0] for own in made]

        for batch in batches:
            found = numbered(*batch.columns[1 + n_scope : 3 + n_scope])  # of the whole batch: each look-up hashes the block's words anew
            for start in range(0, batch.num_rows, PIECE):
                columns = batch.slice(start, PIECE).columns
                ids, scopes = columns[0].to_pylist(), [c.to_pylist() for c in columns[1 : 1 + n_scope]]
                texts, vectors = found[start : start + PIECE], _vectors(columns[3 + n_scope]) if with_vector else None
                members: dict[tuple, list[int]] = {}
                for row, key in enumerate(zip(*scopes, strict=True) if n_scope else [()] * len(ids)):
                    if key in known and None not in key:
                        members.setdefault(key, []).append(row)
                for key, rows in members.items():
                    rows.sort(key=lambda r: ids[r])
                    step = max(1, CELLS // len(known[key].ids))
                    for at in range(0, len(rows), step):
                        part = rows[at : at + step]
                        take = lambda c, part=part: [c[r] for r in part]
                        use(state, key, known[key], take(ids), take(texts), take(vectors) if with_vector else None)
            pa.default_memory_pool().release_unused()  # Arrow's pool else keeps what varying batches have freed, more with each
        yield ended(state)

    return docs.mapInArrow(run, out)


def _best_rows(state: dict, kinds: pa.Schema) -> pa.RecordBatch:
    rows = [(ids[q], doc, -score) for ids, best in state.values() for q, own in enumerate(best.rows) for score, doc in own]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.field(i).type) for i in range(3)], schema=kinds)


def _kinds(queries: DataFrame, docs: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    q, d = queries.schema["query_id"].dataType, docs.schema["doc_id"].dataType
    return f"query_id {q.simpleString()}, doc_id {d.simpleString()}, score double", pa.schema([("query_id", to_arrow_type(q)), ("doc_id", to_arrow_type(d)), ("score", pa.float64())])


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int = 8, *, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, overlap, rank) by shared distinct tokens; tables are (query_id, text) and (doc_id, text) and the scope columns.

    A block of queries goes to every task as an inverted list; each document's tokens are looked up in it once, where the
    document is, and only ``k`` documents of each task and query are shuffled. Documents sharing no token, without an id
    or with a null in the scope aren't returned.
    """
    q = queries.select("query_id", *scope, tokens(F.col("text")).alias("_t")).where("size(_t) > 0")
    d = docs.where("doc_id is not null").select(*_searched(docs, scope)).where("size(_t) > 0 or _o is not null")
    schema, kinds = _kinds(queries, docs)

    def use(state, key, asked, ids, texts, _):
        own = state.setdefault(key, (asked.ids, _Best(len(asked.ids), k)))[1]
        found = asked.overlaps(texts).astype(float)
        found[found == 0] = -np.inf
        own.add(ids, found)

    out = None
    for asked in _query_blocks(q):
        found = _scored(d, asked, scope, schema, use, lambda state: _best_rows(state, kinds))
        out = found if out is None else out.union(found)
    return _top(out, "query_id", "doc_id", "score", k).select("query_id", "doc_id", F.col("score").cast("long").alias("overlap"), "rank")


def dense_topk(queries: DataFrame, docs: DataFrame, k: int = 8, *, scope: Sequence[str] = (), doc_block: int = 8192, query_block: int = 16_384) -> DataFrame:
    """(query_id, doc_id, score, rank) by cosine within the scope; tables are (query_id, vector) and (doc_id, vector).

    Blocks of queries meet blocks of documents as matrices and only each
    block's ``k`` best go on, so the pairs themselves are never rows; documents
    are sent once for every ``query_block`` queries. Documents
    without a vector aren't found; another length or a zero norm scores 0;
    scores are compared to nine digits, equal ones rank by document.
    """
    ship(docs.sparkSession)
    keys = [f"_s{i}" for i in range(len(scope))] or ["_s0"]
    named = [F.col(c).alias(a) for c, a in zip(scope, keys, strict=False)] or [F.lit(0).alias("_s0")]
    vector = F.col("vector").cast("array<double>").alias("_v")
    d = docs.select(*named, F.col("doc_id").alias("_id"), vector).where("size(_v) > 0")
    q = queries.select(*named, F.col("query_id").alias("_id"), vector).where("size(_v) > 0")
    kinds = [dict(q.dtypes)["_id"], dict(d.dtypes)["_id"]]

    def parts(df: DataFrame, block: int, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    sizes = parts(d, doc_block, "_nd").join(parts(q, query_block, "_nq"), keys)
    place = lambda df, own, other, n_own, n_other: df.join(sizes, keys).select(
        *keys, "_id", "_v", F.pmod(F.xxhash64("_id"), F.col(n_own)).cast("int").alias(own), F.explode(F.expr(f"sequence(0, {n_other} - 1)")).alias(other)
    )
    left, right = place(q, "_qb", "_db", "_nq", "_nd"), place(d, "_db", "_qb", "_nd", "_nq")

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            ids, lengths = held["_id"].to_numpy(), held["_v"].map(len).to_numpy()
            by_length = {}
            for n in set(lengths.tolist()):
                rows = np.flatnonzero(lengths == n)
                matrix = np.stack(held["_v"].to_numpy()[rows])
                norms = np.linalg.norm(matrix, axis=1, keepdims=True)
                by_length[n] = rows, np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)
            for query, v in zip(asked["_id"], asked["_v"], strict=True):
                scores = np.zeros(len(ids))
                if len(v) in by_length and (norm := np.linalg.norm(v)) > 0:
                    rows, matrix = by_length[len(v)]
                    scores[rows] = np.round(matrix @ (np.asarray(v) / norm), 9)
                top = np.lexsort((ids, -scores))[:k]
                out.append(pd.DataFrame({"query_id": query, "doc_id": ids[top], "score": scores[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "doc_id": [], "score": []})

    group = [*keys, "_qb", "_db"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(best, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")
    return _top(found, "query_id", "doc_id", "score", k)


def hybrid_topk(queries: DataFrame, docs: DataFrame, k: int = 8, *, weight: float = 0.5, scope: Sequence[str] = ()) -> DataFrame:
    """(query_id, doc_id, score, rank): ``weight`` of the scaled token overlap and the rest of the scaled cosine.

    Tables are (query_id, text, vector) and (doc_id, text, vector). Both are scaled to 0..1 between a query's least and
    greatest value (0 without a spread). A first pass finds these, a second one the ``k`` best; a block of queries goes to
    every task, and only the least and greatest values and each task's ``k`` best are shuffled. Scores are compared to
    nine digits.
    """
    vector = F.col("vector").cast("array<double>").alias("_v")
    q = queries.select("query_id", *scope, tokens(F.col("text")).alias("_t"), vector)
    d = docs.where("doc_id is not null").select(*_searched(docs, scope), vector)
    schema, kinds = _kinds(queries, docs)
    ends_schema = schema.split(", doc_id")[0] + ", lo_l double, hi_l double, lo_c double, hi_c double"

    def both(asked, texts, vectors):
        return asked.overlaps(texts).astype(float), np.round(asked.cosines(vectors), 9)

    def span(state, key, asked, ids, texts, vectors):
        own = state.setdefault(key, (asked.ids, np.tile([[np.inf], [-np.inf], [np.inf], [-np.inf]], len(asked.ids))))[1]
        for row, values in ((0, (m := both(asked, texts, vectors))[0]), (2, m[1])):
            own[row] = np.minimum(own[row], values.min(0))
            own[row + 1] = np.maximum(own[row + 1], values.max(0))

    def spans(state):
        ids = [i for own, _ in state.values() for i in own]
        ends = np.concatenate([e for _, e in state.values()], 1) if state else np.zeros((4, 0))
        return pa.RecordBatch.from_arrays([pa.array(ids, kinds.field(0).type), *map(pa.array, ends)], names=["query_id", "lo_l", "hi_l", "lo_c", "hi_c"])

    out = None
    for asked in _query_blocks(q):
        ends = _scored(d, asked, scope, ends_schema, span, spans).groupBy("query_id")
        ends = {r.query_id: r for r in ends.agg(*[f(c).alias(c) for c, f in (("lo_l", F.min), ("hi_l", F.max), ("lo_c", F.min), ("hi_c", F.max))]).collect()}  # one row a query of the block

        def use(state, key, asked, ids, texts, vectors, ends=ends):
            own = state.setdefault(key, (asked.ids, _Best(len(asked.ids), k)))[1]
            score = np.zeros((len(ids), len(asked.ids)))
            for values, low, high, part in zip(both(asked, texts, vectors), ("lo_l", "lo_c"), ("hi_l", "hi_c"), (weight, 1 - weight), strict=True):
                lo = np.array([ends[i][low] for i in asked.ids])
                wide = np.array([ends[i][high] for i in asked.ids]) - lo
                score += part * np.where(wide < 1e-9, 0.0, (values - lo) / np.where(wide < 1e-9, 1.0, wide))
            own.add(ids, np.round(score, 9))

        found = _scored(d, asked, scope, schema, use, lambda state: _best_rows(state, kinds))
        out = found if out is None else out.union(found)
    return _top(out, "query_id", "doc_id", "score", k)


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 8, *, mode: str = "hybrid", scope: Sequence[str] = (), gold: DataFrame | None = None, distractors: int = 3) -> DataFrame:
    """(query_id, doc_id, score, rank) by ``lexical``, ``dense`` or ``hybrid`` search, or ``golden``: the documents of ``gold``
    (query_id, doc_id, position), then lexically nearest others, without scores.

    Dense and hybrid searches need vectors: queries without one, and those in whose scope no document has one, are answered
    by lexical search. Query ids are unique.
    """
    plain = lambda q: lexical_topk(q, docs, k, scope=scope).select("query_id", "doc_id", F.col("overlap").cast("double").alias("score"), "rank")
    if mode == "lexical":
        return plain(queries)
    if mode == "golden":
        if gold is None:
            raise ValueError("golden retrieval needs gold documents")
        found = golden(gold, lexical_topk(queries, docs, k, scope=scope).select("query_id", "doc_id", "rank"), k, distractors)
        return found.select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "rank")
    if mode not in ("dense", "hybrid"):
        raise ValueError(f"unknown mode {mode}: lexical, dense, hybrid or golden")
    held, able = docs.where("size(vector) > 0"), queries.where("size(vector) > 0")
    if scope:
        able = able.join(held.select(*scope).distinct(), list(scope), "left_semi")
    elif held.isEmpty():
        able = able.limit(0)
    found = dense_topk(able, docs, k, scope=scope) if mode == "dense" else hybrid_topk(able, docs, k, scope=scope)
    rest = queries.join(able.select("query_id"), "query_id", "left_anti")
    return found.select("query_id", "doc_id", "score", "rank").unionByName(plain(rest))


def near_duplicates(df: DataFrame, threshold: float = 0.97, *, key: str, vector: str, within: Sequence[str], block: int = 2048) -> DataFrame:
    """(within, left, right, score): pairs of one group with a cosine of at least ``threshold``, left before right.

    Groups are cut into blocks of about ``block`` rows and each two blocks are
    compared as matrices, so only pairs that qualify become rows. Null vectors
    and those of zero norm have no pairs; lengths must agree to be compared.
    """
    ship(df.sparkSession)
    rows = df.select(*within, F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where("_k is not null and size(_v) > 0")
    sizes = rows.groupBy(*within).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    sizes = sizes.withColumnsRenamed({c: f"_g_{c}" for c in within})
    cond = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in within]
    placed = rows.join(sizes, cond).select(*within, "_k", "_v", "_n").withColumn("_b", F.pmod(F.xxhash64("_k"), F.col("_n")).cast("int"))
    other = F.expr("sequence(0, _n - 1)")
    spread = placed.withColumn("_o", F.explode(other)).select(*within, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b", "_k", "_v")
    kinds = dict(df.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in within], f"left {kinds[key]}, right {kinds[key]}, score double"])

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(_len=pdf["_v"].map(len))
        for _, part in pdf.groupby("_len"):
            matrix = np.stack(part["_v"].to_numpy())
            norms = np.linalg.norm(matrix, axis=1)
            part, matrix = part[norms > 0], matrix[norms > 0] / norms[norms > 0, None]
            at, keys = part["_b"].to_numpy(), part["_k"].to_numpy()
            i, j = int(pdf["_i"].iloc[0]), int(pdf["_j"].iloc[0])
            a, b = np.flatnonzero(at == i), np.flatnonzero(at == j)
            x, y = np.nonzero(matrix[a] @ matrix[b].T >= threshold)
            pairs = [(keys[p], keys[q], float(matrix[p] @ matrix[q])) for p, q in zip(a[x], b[y], strict=True)]
            out += [(min(p, q), max(p, q), s) for p, q, s in pairs if p < q or (i != j and p > q)]
        found = pd.DataFrame(out, columns=["left", "right", "score"])
        for c in reversed(list(within)):
            found.insert(0, c, pdf[c].iloc[0])
        return found

    return spread.groupBy(*within, "_i", "_j").applyInPandas(compare, schema)


def golden(gold: DataFrame, lexical: DataFrame, k: int = 8, distractors: int = 3) -> DataFrame:
    """(query_id, doc_id, rank): the gold documents (query_id, doc_id, position), then lexically nearest others up to ``k`` or gold + distractors."""
    n_gold = gold.groupBy("query_id").agg(F.count("*").alias("_g"))
    others = lexical.join(gold, ["query_id", "doc_id"], "left_anti").join(n_gold, "query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_gold", "_at", "doc_id"))
    both = gold.select("query_id", "doc_id", F.lit(0).alias("_gold"), F.col("position").alias("_at"), F.lit(0).cast("long").alias("_g"))
    both = both.union(others.select("query_id", "doc_id", F.lit(1), "rank", "_g"))
    out = both.withColumn("rank", rank).where(F.col("rank") <= F.greatest(F.lit(k), F.col("_g") + distractors))
    return out.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
