"""Exact top-k by inner product: term-at-a-time accumulation over blocks of postings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm import common
from quill.llm.rans import _arrow, _batch

#: Rows of a block of candidates and of a block of queries: what one task holds at once. AT_ONCE queries have score arrays together.
CANDIDATES, QUERIES, AT_ONCE = 16_384, 32_768, 64
#: Doubles hold integers below this exactly; scores that could reach it are summed up as Python's integers instead.
SAFE = 1 << 53


class Vectors:
    """Rows of vectors of any lengths, as ids and one array of components."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.ids, self.sizes, self.flat = ids, sizes, flat
        self.row = np.repeat(np.arange(len(ids)), sizes)
        self.term = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.largest = float(np.abs(flat.astype(np.float64)).max(initial=0))

    @classmethod
    def of(cls, parts: list[tuple]) -> Vectors:
        return cls(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    def some(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """The components of some rows at some (ascending) terms, zero where there are none."""
        out = np.zeros((len(rows), len(terms)))
        if len(terms):
            for k, r in enumerate(rows):
                begin = int(self.starts[r])
                v = self.flat[begin : begin + self.sizes[r]]
                n = np.searchsorted(terms, len(v))
                out[k, :n] = v[terms[:n]]
        return out

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


class Postings:
    """A block of candidates as one posting list a term: the rows that have it, and their weights.

    Lists that at least half of the rows are in are kept as rows of a matrix, zero elsewhere, and accumulated together.
    """

    def __init__(self, rows: Vectors):
        self.rows = rows
        there = np.flatnonzero(rows.flat)
        there = there[np.argsort(rows.term[there], kind="stable")]
        terms, first = np.unique(rows.term[there], return_index=True)
        cut = [*first.tolist(), len(there)]
        lists = {int(t): (rows.row[there[a:b]], rows.flat[there[a:b]]) for t, a, b in zip(terms, cut[:-1], cut[1:], strict=True)}
        self.full = np.array([t for t, (r, _) in lists.items() if 2 * len(r) >= len(rows.ids)], dtype=np.int64)
        self.matrix = np.zeros((len(self.full), len(rows.ids)))
        for k, t in enumerate(self.full.tolist()):
            r, w = lists.pop(t)
            self.matrix[k, r] = w
        self.lists = lists
        self.order = np.argsort(rows.ids, kind="stable")
        self.sorted = rows.ids[self.order]
        self.terms = len(terms)

    def scores(self, queries: Vectors, some: np.ndarray) -> np.ndarray:
        """A dense array of every row's score for each of some queries: their terms scatter weighted postings into it."""
        if queries.largest * self.rows.largest * max(1, self.terms) >= SAFE:
            return np.stack([self._exact(queries, q) for q in some])
        out = queries.some(some, self.full) @ self.matrix
        if self.lists:
            for k, q in enumerate(some):
                begin = int(queries.starts[q])
                v = queries.flat[begin : begin + queries.sizes[q]]
                for t in np.flatnonzero(v).tolist():
                    if t in self.lists:
                        rows, weights = self.lists[t]
                        out[k, rows] += weights * float(v[t])
        return out

    def _exact(self, queries: Vectors, q: int) -> np.ndarray:
        """The same with integers of any size; scores beyond 64 bits are cut to the largest that fits."""
        v = queries.flat[queries.row == q].tolist()
        out = [0] * len(self.rows.ids)
        for r, t, w in zip(self.rows.row.tolist(), self.rows.term.tolist(), self.rows.flat.tolist(), strict=True):
            if t < len(v):
                out[r] += w * v[t]
        return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in out], dtype=object)

    def top(self, queries: Vectors, k: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Each query's number and the k best (vec_id, score) but for its own id, ties to the smaller id."""
        ids = self.rows.ids
        for at in range(0, len(queries.ids), AT_ONCE):
            some = np.arange(at, min(at + AT_ONCE, len(queries.ids)))
            s = self.scores(queries, some)
            begin, end = (np.searchsorted(self.sorted, queries.ids[some], side) for side in ("left", "right"))
            for own, q, b, e in zip(s, some.tolist(), begin.tolist(), end.tolist(), strict=True):
                rows = np.arange(len(ids)) if b == e else np.delete(np.arange(len(ids)), self.order[b:e])
                if len(rows) > k:
                    floor = np.partition(own[rows], len(rows) - k)[len(rows) - k]
                    rows = rows[own[rows] >= floor]
                best = rows[np.lexsort((ids[rows], -own[rows]))[:k]]
                yield q, [(int(ids[r]), int(own[r])) for r in best]


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and floor(256 x) of each component, as doubles hold them; rows with a null id, or a null or non-finite component, are left out."""
    x = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~bad).select("vec_id", F.transform("v", lambda c: F.floor(c * 256.0)).alias("v"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row over all rows but its own id.

    Both tables have vec_id and v, an array of long; a missing component is a term that isn't there, so lengths may differ.
    Ties go to the smaller vec_id. With fewer rows, all come back. Repeated candidate rows are ranked as often as they come.
    Repeated query rows answer once; rows of one vec_id and different vectors are queries of their own, each with its ranks.
    No rows, no result. A score beyond 64 bits is cut to the largest that fits.

    Equal candidate rows are summed up first, so that no share of copies is hot; over k of them can't all be among k best.
    Rows are dealt by a hash into blocks of candidates and blocks of queries of bounded size; each pair of blocks is one
    group, whose task holds two blocks, whatever the tables' sizes. Each returns k rows a query, which are then merged.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    n, m = vectors.count(), queries.count()
    blocks, asked = max(1, -(-n // CANDIDATES)), max(1, -(-m // QUERIES))
    cell = F.col("c") * asked + F.col("q")
    rows = vectors.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).alias("times")).withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)))
    rows = rows.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(asked - 1).cast("long")))).select(cell.alias("cell"), F.lit(False).alias("asks"), "vec_id", "times", "v")
    wants = queries.select("vec_id", "v").distinct().withColumn("ask", F.xxhash64("v")).withColumn("q", F.pmod(F.xxhash64("vec_id", "ask"), F.lit(asked)))
    wants = wants.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).select(cell.alias("cell"), F.lit(True).alias("asks"), "vec_id", F.col("ask").alias("times"), "v")
    schema = "query_id long, ask long, vec_id long, score long"

    def run(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        """Rows come by cell, candidates before queries."""
        at, parts, block = None, [], None
        for b in batches:
            cells, asks, ids, more = (np.asarray(b.column(i)) for i in range(4))
            sizes = np.asarray(b.column(4).value_lengths()).astype(np.int64)
            flat, ends = np.asarray(b.column(4).flatten()), np.cumsum(sizes)
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if s == e:
                    continue
                if cells[s] != at:
                    at, parts, block = cells[s], [], None
                begin = int(ends[s] - sizes[s])
                own = (ids[s:e], sizes[s:e], flat[begin : int(ends[e - 1])])
                if not asks[s]:
                    parts.append(own)
                    for extra in range(1, int(more[s:e].max())):
                        again = np.flatnonzero(more[s:e] > extra)
                        parts.append((own[0][again], own[1][again], np.concatenate([flat[int(ends[s + j] - sizes[s + j]) : int(ends[s + j])] for j in again])))
                    continue
                if not parts:
                    continue
                block = block or Postings(Vectors.of(parts))
                out = []
                for q, best in block.top(Vectors(*own), k):
                    out += [(int(own[0][q]), int(more[s + q]), *r) for r in best]
                    if len(out) >= 50_000:
                        yield _batch(out, arrow)
                        out = []
                if out:
                    yield _batch(out, arrow)

    arrow = _arrow(schema)
    cells = rows.unionByName(wants).repartition(max(common.partitions(spark), 1), "cell").sortWithinPartitions("cell", "asks", "vec_id")
    best = cells.mapInArrow(lambda b: run(b, arrow), schema)
    rank = F.row_number().over(Window.partitionBy("query_id", "ask").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v AS ask, c.vec_id,
         CAST(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, ask ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
