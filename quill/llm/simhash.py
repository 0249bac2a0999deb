"""SimHash: fingerprints, near-duplicate classes by vantage-point trees, and permuted block tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common, graph
from quill.llm.rans import _arrow, _batch

#: Rows that a shard of a vantage-point forest should have; a front of a block table with more is searched as pairs of blocks of this size.
SHARD = 4096
#: The trees are fitted on so many fingerprints at most, so many a leaf, which bounds their size.
SAMPLE, SAMPLES_A_LEAF = 1 << 18, 32
#: Rows that are compared bit by bit rather than split further.
LEAF = 96
#: Texts of a candidate class of more bytes are compared as pairs of blocks of this size.
SHARD_BYTES = 32 << 20
_BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
_PLACE = (np.arange(8) * 256)[None, :]


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of the whole sequence if it's shorter; none without words."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.empty(0, dtype="<u8")
    runs = map(b" ".join, zip(*(islice(found, k, None) for k in range(words)))) if len(found) >= words else [b" ".join(found)]
    h = partial(xxhash.xxh64_intdigest, seed=seed)
    return np.fromiter(map(h, runs), dtype="<u8")


def votes(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    if not len(hashes):
        return np.zeros(64, dtype=np.int64)
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _PLACE).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent 64-bit hashes made from one: k = 0 is the hash itself."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, words: int, lanes: int = 1) -> bytes:
    """64 bits a lane, little-endian: a bit is set if it is in over half of the shingles' hashes."""
    h = shingle_hashes(text, words)
    return b"".join(np.packbits(2 * votes(mixed(h, k)) > len(h), bitorder="little").tobytes() for k in range(lanes))


def _mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    arrow = _arrow(schema)
    return df.mapInArrow(lambda b: f(b, arrow), schema)


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """doc_id, fp (binary, little-endian) and a number for it, of each whole text; null texts count as empty."""

    def run(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            found = [fingerprint(t, words, lanes) for t in b.column(1).to_pylist()]
            nodes = np.frombuffer(b"".join(f if lanes == 1 else xxhash.xxh64_digest(f) for f in found), "<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), pa.array(nodes)], schema=arrow)

    return _mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), run, "doc_id long, fp binary, node long")


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits between rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


@dataclass
class Ring:
    """A node of a vantage-point tree: a point, the half of the bits its distances are taken in (None: all), the margin and the cut.

    Rows at a distance of at most cut are inside. A pair within the margin of each other has distances from the point that
    differ by the margin at most: a row whose distance less the margin is at most cut may have its pair inside, and one whose
    distance plus the margin is over cut may have it outside. No other row need look there.
    """

    point: np.ndarray
    mask: np.ndarray
    margin: int
    cut: int
    inside: Ring | int = -1
    outside: Ring | int = -1

    def far(self, rows: np.ndarray) -> np.ndarray:
        return np.bitwise_count((rows ^ self.point) & self.mask).sum(axis=-1, dtype=np.int64)


def halves(lanes: int) -> list[np.ndarray]:
    """Masks of the two halves of a fingerprint's bits: a pair within r bits differs in at most r // 2 bits of one of them."""
    if lanes > 1:
        front = np.where(np.arange(lanes) < lanes // 2, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    else:
        front = np.array([0xFFFFFFFF], dtype=np.uint64)
    return [front, ~front]


def ring(rows: np.ndarray, half: np.ndarray, radius: int) -> Ring | None:
    """A node that splits rows as evenly as their distances from the first one let it; None if no distances differ.

    Distances are taken in one half of the bits, whose margin is smaller, for another tree takes them in the other half; where
    that leaves over nine tenths of the rows together, as in a dense group, in all bits. A tree that stands alone has the
    mask of all bits and the whole radius as its margin.
    """
    best, whole = None, ~np.zeros_like(half)
    for mask, margin in ((whole, radius),) if (half == whole).all() else ((half, radius // 2), (whole, radius)):
        d = np.bitwise_count((rows ^ rows[0]) & mask).sum(axis=-1, dtype=np.int64)
        seen = np.cumsum(np.bincount(d))
        if len(seen) < 2:
            continue
        cut = int(np.argmin(np.abs(seen[:-1] * 2 - len(rows))))
        share = max(seen[cut], len(rows) - seen[cut]) / len(rows)
        if share < 1 and (best is None or share < best[0]):
            best = (share, Ring(rows[0], mask, margin, cut))
        if share <= 0.9:
            break
    return best and best[1]


def tree(rows: np.ndarray, half: np.ndarray, radius: int, leaf: int) -> tuple[Ring | int, int]:
    """A vantage-point tree over a sample, its leaves numbered, and how many they are."""
    number = 0

    def build(own: np.ndarray) -> Ring | int:
        nonlocal number
        node = ring(own, half, radius) if len(own) > leaf else None
        if node is None:
            number += 1
            return number - 1
        inner = node.far(own) <= node.cut
        node.inside, node.outside = build(own[inner]), build(own[~inner])
        return node

    return build(rows), number


def routed(root: Ring | int, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each leaf that any row reaches: its number, the rows that live there, and the rows that only look there.

    A row lives in one leaf. It looks into each other leaf that the triangle bound can't rule out; of two rows that live on
    either side of a ring, the outer one looks inside, which is enough to find the pair.
    """
    stack = [(root, np.arange(len(rows)), np.empty(0, dtype=np.int64))]
    while stack:
        node, home, guest = stack.pop()
        if not len(home) and not len(guest):
            continue
        if isinstance(node, int):
            yield node, home, guest
            continue
        d, g = node.far(rows[home]), node.far(rows[guest])
        inner = d <= node.cut
        looks = home[~inner & (d - node.margin <= node.cut)]
        stack.append((node.inside, home[inner], np.concatenate([guest[g - node.margin <= node.cut], looks])))
        stack.append((node.outside, home[~inner], guest[g + node.margin > node.cut]))


def shard_links(home: np.ndarray, guest: np.ndarray, half: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the radius among a shard's own rows and between them and its guests; guests count from len(home).

    The shard's tree goes on as the forest's does, for all its rows at once; leaves are compared bit by bit, in blocks.
    """
    rows = np.concatenate([home, guest])
    found = []
    stack = [(np.arange(len(home)), np.arange(len(home), len(rows)))]
    while stack:
        own, more = stack.pop()
        if not len(own) or len(own) + len(more) < 2:
            continue
        node = ring(rows[own], half, radius) if len(own) > LEAF else None
        if node is None:
            every = np.concatenate([own, more])
            step = max(1, (1 << 20) // len(own))
            for k in range(0, len(every), step):
                i, j = np.nonzero(hamming(rows[every[k : k + step], None], rows[own][None]) <= radius)
                keep = i + k > j
                if keep.any():
                    found.append((every[i[keep] + k], own[j[keep]]))
            continue
        d, g = node.far(rows[own]), node.far(rows[more])
        inner = d <= node.cut
        stack.append((own[inner], np.concatenate([more[g - node.margin <= node.cut], own[~inner & (d - node.margin <= node.cut)]])))
        stack.append((own[~inner], more[g + node.margin > node.cut]))
    return found


def _shards(batches: Iterable[pa.RecordBatch], radius: int, masks: list[np.ndarray] | None, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Edges from rows (key, guest, node, fp) in order of key, a key's own rows before its guests; each key is a shard.

    Memory is bounded by a shard's own rows; guests are looked up a block at a time. A key's remainder by the number of masks
    says which half its tree splits.
    """
    edges: list[tuple[int, int]] = []

    def links(home: list, guests: list, key: int, own: bool) -> None:
        ids, fps = (np.concatenate([x[k] for x in home]) for k in range(2))
        more, their = (np.concatenate([x[k] for x in guests]) for k in range(2)) if guests else (ids[:0], fps[:0])
        every = np.concatenate([ids, more])
        half = masks[key % len(masks)] if masks else ~np.zeros(fps.shape[1], dtype=np.uint64)
        for a, b in shard_links(fps, their, half, radius):
            if not own:
                a, b = a[a >= len(ids)], b[a >= len(ids)]
            a, b = every[a], every[b]
            edges.extend(zip(*(x.tolist() for x in (graph.stars(a, b) if len(a) > 4096 else (a, b))), strict=True))

    def shut() -> None:
        if home and (fresh or guests):
            links(home, guests, key, fresh)

    key, home, guests, waiting, lived, fresh = None, [], [], 0, 0, True
    for b in batches:
        if not b.num_rows:
            continue
        keys, looks, ids = (np.asarray(b.column(k)) for k in (0, 1, 2))
        rows = np.frombuffer(b"".join(b.column(3).to_pylist()), "<u8").reshape(b.num_rows, -1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]) | (looks[1:] != looks[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[s] != key:
                shut()
                key, home, guests, waiting, lived, fresh = int(keys[s]), [], [], 0, 0, True
            if not looks[s]:
                home.append((ids[s:e], rows[s:e]))
                lived += e - s
            elif home:
                guests.append((ids[s:e], rows[s:e]))
                waiting += e - s
                if waiting >= max(lived, 1 << 16):
                    links(home, guests, key, fresh)
                    guests, waiting, fresh = [], 0, False
        if len(edges) > 200_000:
            edges = graph.forest(edges)
    shut()
    out = graph.forest(edges)
    for k in range(0, len(out), 50_000):
        yield _batch(out[k : k + 50_000], arrow)


_KEYED = "key long, guest boolean, node long, fp binary"


def _linked(keyed: DataFrame, radius: int, masks: list[np.ndarray] | None = None) -> DataFrame:
    parts = common.partitions(keyed.sparkSession)
    dealt = keyed.repartition(parts, "key").sortWithinPartitions("key", "guest")
    return common.materialise(_mapped(dealt, lambda b, arrow: _shards(b, radius, masks, arrow), "a long, b long"), "links")[0]


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def vantage_links(nodes: DataFrame, lanes: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect all of nodes (node long, fp binary) whose fingerprints differ in at most radius bits.

    Two vantage-point trees, one by the distances in either half of the bits, deal the fingerprints out to shards. A pair
    within the radius differs in at most half as many bits in one of the halves, so that half's tree needs only that margin:
    each row goes to the shard it lives in, and to every other shard that a ring of the margin around its distances reaches.
    Nothing else is pruned, so no pair is lost. The trees are fitted on a sample of SAMPLE fingerprints at most (the smallest
    hashes), with a leaf for every SHARD rows expected; a shard goes on splitting its own rows alike, and compares whole
    fingerprints in the end. Each task returns a spanning forest of its links, never all pairs of a group.
    """
    rows = nodes.count()
    leaves = max(1, min(SAMPLE // SAMPLES_A_LEAF, -(-rows // SHARD)))
    masks = halves(lanes)
    roots = [0, 0]
    if leaves > 1:
        wanted = leaves * SAMPLES_A_LEAF
        draw = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
        drawn = nodes.filter(draw < int(min(1.0, 1.2 * wanted / rows) * (1 << 30)) + 1).orderBy(draw, "node").limit(wanted).select("fp").collect()
        sample = np.frombuffer(b"".join(r["fp"] for r in drawn), "<u8").reshape(len(drawn), -1)
        roots = [tree(sample, m, radius, 2 * SAMPLES_A_LEAF)[0] for m in masks]

    def deal(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            fps = _words(b.column(1))
            for t, root in enumerate(roots):
                for leaf, home, guest in routed(root, fps):
                    own = pa.array(np.concatenate([home, guest]))
                    looks = np.arange(len(own)) >= len(home)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), 2 * leaf + t)), pa.array(looks), b.column(0).take(own), b.column(1).take(own)], schema=arrow)

    return _linked(_mapped(nodes.select("node", "fp"), deal, _KEYED), radius, masks)


def block_links(nodes: DataFrame, lanes: int, tables: int, width: int, radius: int) -> DataFrame:
    """Edges (a, b) that connect nodes (node long, fp binary) whose fingerprints differ in at most radius bits, by permuted block tables.

    Each table brings another block of so many bits to the front; only fingerprints with the same front are compared, over
    all bits. With more tables than radius, and blocks that don't overlap, a pair within the radius agrees in some block, so
    none is missed. With fewer, or with blocks of the same bits in other orders (as many as it takes once the bits are used
    up), a pair is missed only if it differs in every block. A front with over SHARD rows is dealt out as pairs of blocks of
    rows, by a hash of the fingerprint, so that no task holds it whole.
    """
    spark = nodes.sparkSession
    bits = 64 * lanes
    each = bits // width
    order = [np.arange(bits), *(np.random.default_rng(k).permutation(bits) for k in range(1, -(-tables // each)))]
    fronts = [order[k // each][k % each * width : (k % each + 1) * width] for k in range(tables)]

    def deal(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            every = np.unpackbits(_words(b.column(1)).view(np.uint8).reshape(b.num_rows, -1), axis=1, bitorder="little")
            for k, front in enumerate(fronts):
                key = (every[:, front].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))) * tables + k
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.zeros(b.num_rows, dtype=bool)), b.column(0), b.column(1)], schema=arrow)

    held, at = common.materialise(_mapped(nodes.select("node", "fp"), deal, _KEYED), "blocks")
    large = held.groupBy("key").agg(F.count("*").alias("rows")).filter(F.col("rows") > SHARD)
    spread, large_at = common.materialise(large, "large-blocks")
    n = F.coalesce(F.ceil(F.col("rows") * 2 / SHARD).cast("int"), F.lit(1))
    dealt = (
        held.join(spread, "key", "left")
        .withColumn("n", n)
        .withColumn("own", F.pmod(F.xxhash64("fp", "node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "guest", "node", "fp")
    )
    out = _linked(dealt, radius)
    common.discard(spark, at, large_at)
    return out


def _classes(marked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component_id (the smallest first of the nodes that edges connect) of each of nodes (node, first), as a written table."""
    linked = nodes.join(graph.components(edges), "node").select("node", "root", "first")
    smallest = linked.groupBy("root").agg(F.min("first").alias("least"))
    classes = linked.join(smallest, "root").select("node", "least")
    return common.materialise(nodes.join(classes, "node", "left").select("node", F.coalesce("least", "first").alias("component_id")), "classes")[0]


def near_classes(docs: DataFrame, words: int = 3, radius: int = 3, lanes: int = 1) -> DataFrame:
    """doc_id, fp and component_id of each document: the smallest doc_id reachable over links of at most radius differing bits.

    docs needs doc_id and text; other columns are ignored. Texts without words have fingerprint zero. Equal fingerprints
    are one node, so a third of all rows may be copies of one text. Rows with a null doc_id link as others do, but give no
    component_id; a class of such rows alone has null. Repeated rows are returned as often as they come. An empty table
    gives no rows.
    """
    common.ship(docs.sparkSession)
    marked, _ = common.materialise(fingerprints(docs, words, lanes), "fingerprints")
    nodes, _ = common.materialise(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("first")), "nodes")
    named = _classes(marked, nodes, vantage_links(nodes, lanes, radius))
    return marked.join(named, "node").select("doc_id", "fp", "component_id")


def set_fingerprints(docs: DataFrame, words: int, lanes: int) -> DataFrame:
    """doc_id, fp of the text's set of shingles (repeats count once), node (a hash of that set) and same (a hash of the text)."""

    def run(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            fps, nodes = [], []
            for t in b.column(1).to_pylist():
                h = np.unique(shingle_hashes(t, words))
                fps.append(b"".join(np.packbits(2 * votes(mixed(h, k)) > len(h), bitorder="little").tobytes() for k in range(lanes)))
                nodes.append(xxhash.xxh64_digest(h.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary()), pa.array(np.frombuffer(b"".join(nodes), "<i8")), b.column(2)], schema=arrow)

    text = docs["text"].cast("string")
    return _mapped(docs.select(docs["doc_id"].cast("long"), text, F.xxhash64(text)), run, "doc_id long, fp binary, node long, same long")


def set_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges from one set of each class to its others; a class is what pairs of a Jaccard similarity of at least so much connect.

    Sets are sorted, without repeats. Each found set is a query once: its elements' postings count what it shares with all
    others, so likenesses are exact. An edge's own ends may be less alike; stars keep a long chain's ends two edges apart.
    """
    size = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(sets)), size)[np.argsort(element, kind="stable")]
    post = np.concatenate([[0], np.cumsum(np.bincount(element))])
    alive = np.ones(len(sets), dtype=bool)
    out = []
    for start in range(len(sets)):
        if not alive[start]:
            continue
        alive[start] = False
        queue = [start]
        while queue:
            k = queue.pop()
            own = element[begin[k] : begin[k + 1]]
            if not len(own):
                continue
            shared = np.bincount(np.concatenate([owner[post[e] : post[e + 1]] for e in own]), minlength=len(sets))
            found = np.flatnonzero(alive & (shared >= least * (size + size[k] - shared) - 1e-9))
            alive[found] = False
            out += [(start, int(j)) for j in found]
            queue += found.tolist()
    return out


def verified(texts: DataFrame, words: int, least: float) -> DataFrame:
    """Edges (a, b) that connect all texts (root long, node long, text) of one root whose shingle sets are at least so alike.

    A root of many rows or bytes is dealt out as pairs of blocks, so that no task holds it whole; no pair is left out.
    """
    spark = texts.sparkSession
    sizes = texts.groupBy("root").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes"))
    n = F.greatest(F.ceil(F.col("rows") * 2 / SHARD), F.ceil(F.col("bytes") * 2 / SHARD_BYTES)).cast("int")
    spread, at = common.materialise(sizes.filter((F.col("rows") > SHARD) | (F.col("bytes") > SHARD_BYTES)).select("root", n.alias("n")), "large-roots")
    dealt = (
        texts.join(spread, "root", "left")
        .withColumn("n", F.coalesce("n", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(F.when(F.col("n") == 1, F.col("root")).otherwise(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "node", "text")
    )

    def run(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        key, nodes, sets, edges = None, [], [], []

        def shard() -> None:
            if len(nodes) > 1:
                edges.extend((nodes[a], nodes[b]) for a, b in set_links(sets, least))

        for b in common.rows_of(batches):
            for k, node, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if k != key:
                    shard()
                    key, nodes, sets = k, [], []
                nodes.append(node)
                sets.append(np.unique(shingle_hashes(text, words)))
            if len(edges) > 50_000:
                yield _batch(edges, arrow)
                edges.clear()
        shard()
        if edges:
            yield _batch(edges, arrow)

    parts = common.partitions(spark)
    out, _ = common.materialise(_mapped(dealt.repartition(parts, "key").sortWithinPartitions("key"), run, "a long, b long"), "verified")
    common.discard(spark, at)
    return out


def tables_for(rows: int, least: float, bits: int) -> tuple[int, int, int]:
    """Tables, bits of a front, and radius of a search for pairs of sets of a Jaccard similarity of at least so much.

    Two sets as alike as that differ in a known share of a fingerprint's bits, by the angle between them. The radius stands
    three deviations above its mean. Fronts grow with the rows, so that a front has about a thousand of them at any size, and
    so do tables, so that a pair right at the similarity agrees in no front only once in 500 cases.
    """
    differ = math.acos(2 * least / (1 + least)) / math.pi
    width = max(12, math.ceil(math.log2(rows + 1)) - 10)
    tables = math.ceil(math.log(0.002) / math.log1p(-((1 - differ) ** width)))
    return tables, width, round(bits * differ + 3 * math.sqrt(bits * differ * (1 - differ)))


def jaccard_classes(docs: DataFrame, words: int, least: float, lanes: int) -> DataFrame:
    """doc_id and component_id of each document: the smallest doc_id reachable over pairs of a Jaccard similarity of at least so much.

    Candidates are the classes over fingerprints of shingle sets, by block tables. (In vantage-point trees such a radius, a
    sixth of the bits, would let every row look into every shard.) Within such a class all pairs are
    decided by their shingle sets themselves, so no pair below least links; one above it is missed only if its fingerprints
    are farther apart than the radius, or differ in every front, and no chain of candidates joins them. Rows are taken and
    returned as by near_classes; texts of equal sets are one node.
    """
    common.ship(docs.sparkSession)
    marked, _ = common.materialise(set_fingerprints(docs, words, lanes), "fingerprints")
    nodes, _ = common.materialise(marked.groupBy("node", "fp").agg(F.min("doc_id").alias("first"), F.min("same").alias("same")), "nodes")
    edges = block_links(nodes, lanes, *tables_for(nodes.count(), least, 64 * lanes))
    likely, likely_at = common.materialise(graph.components(edges).join(nodes, "node").select("node", "root", "same"), "candidates")
    text = docs.select(docs["text"].cast("string").alias("text")).withColumn("same", F.xxhash64("text"))
    texts, texts_at = common.materialise(text.join(likely, "same").groupBy("root", "node").agg(F.first("text").alias("text")), "candidate-texts")
    named = _classes(marked, nodes, verified(texts, words, least))
    common.discard(docs.sparkSession, likely_at, texts_at)
    return marked.join(named, "node").select("doc_id", "component_id")


def hex_digits(fp: bytes) -> str:
    return fp[::-1].hex()


# Weighted document fingerprints and their tables


def weighted_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Bits (64 a lane) for which the terms' weights with the bit set outvote the others; a term's weight is how often it comes."""
    return np.concatenate([2 * votes(mixed(hashes, k)) > len(hashes) for k in range(lanes)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The cosine that the share of differing bits stands for, at least 0; 1 for equal fingerprints."""
    return max(0.0, float(np.cos(np.pi * np.mean(a != b))))


def edited(text: str, following: str) -> str:
    """The last quarter of a text's code points makes room for as many of the following text's first ones, or all of them."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


#: Differing bits of 128 up to which two documents count as near.
NEAR_BITS = 3
_MARKS = "part int, kind int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def _mark(doc: int | None, text: str, own: np.ndarray, following: str, after: np.ndarray, words: int, lanes: int) -> tuple:
    changed = edited(text, following)
    new = weighted_fingerprint(shingle_hashes(changed, words), lanes)
    digits = [hex_digits(np.packbits(x, bitorder="little").tobytes()) for x in (own, new)]
    return (doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), *digits, likeness(own, new), likeness(own, after))


def _marks(batches: Iterable[pa.RecordBatch], words: int, lanes: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's documents in order; its first text (kind 1) and last document (kind 2) go out for the neighbouring parts."""
    from pyspark import TaskContext

    part, before = TaskContext.get().partitionId(), None
    for b in common.rows_of(batches):
        rows = []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            text = text or ""
            own = weighted_fingerprint(shingle_hashes(text, words), lanes)
            if before is None:
                rows.append((part, 1, *[None] * 7, text))
            else:
                rows.append((part, 0, *_mark(*before, text, own, words, lanes), None))
            before = (doc, text, own)
        if rows:
            yield _batch(rows, arrow)
    if before:
        yield _batch([(part, 2, before[0], *[None] * 6, before[1])], arrow)


def document_marks(docs: DataFrame, words: int = 3, lanes: int = 2) -> DataFrame:
    """Each document's fingerprint, its edited text's, and how near its own is to that one and to the next document's.

    docs needs doc_id and text; other columns are ignored. The next document is the next in ascending doc_id order (a null
    first; rows of one doc_id in an order of their texts' hashes), and the first after the last; a single document follows
    itself. Terms are runs of so many words, weighted by their number. Null texts are empty; a text without words has
    fingerprint zero. Equal texts have equal fingerprints. An empty table gives no rows.

    One shuffle orders the texts. Each task walks along its part; a part's last document waits for the first text of the next
    part. Those two rows a part are joined afterwards, so no task sees more than its part and no window spans the table.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = common.key_order(rows, "doc_id", "tie").select("doc_id", "text")
    found, _ = common.materialise(_mapped(ordered, lambda b, arrow: _marks(b, words, lanes, arrow), _MARKS), "marks")
    parts = sorted(r["part"] for r in found.filter("kind = 2").select("part").collect())
    inner = found.filter("kind = 0").drop("part", "kind", "text")
    after = [(p, n) for p, n in zip(parts, parts[1:] + parts[:1], strict=True)]
    heads = found.filter("kind = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    ends = found.filter("kind = 2").select("part", "doc_id", "text").join(spark.createDataFrame(after, "part int, next int"), "part").join(heads, "next").select("doc_id", "text", "following")

    def close(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches, 16):
            out = []
            for r in b.to_pylist():
                own, nxt = (weighted_fingerprint(shingle_hashes(t, words), lanes) for t in (r["text"], r["following"]))
                out.append(_mark(r["doc_id"], r["text"], own, r["following"], nxt, words, lanes))
            if out:
                yield _batch(out, arrow)

    return inner.unionByName(_mapped(ends, close, ", ".join(_MARKS.split(", ")[2:-1])))


def within(prints: DataFrame, radius: int, bits: int = 128) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (node long, fp binary of so many bits) differing in at most radius bits.

    A table for each of radius + 1 blocks of the bits, so none is missed.
    """
    return block_links(prints, bits // 64, radius + 1, bits // (radius + 1), radius)


def near_marks(marks: DataFrame, radius: int = NEAR_BITS, bits: int = 128) -> DataFrame:
    """marks (doc_id, fingerprint and more) with near_id: the smallest doc_id reachable over fingerprints within the radius.

    A document without such a neighbour has its own. Rows without a doc_id link as others do; a class of them alone has null.
    Fingerprints are joined as nodes, each once, so equal texts don't multiply.
    """
    fp = F.unhex("fingerprint")
    keyed = marks.withColumn("node", F.xxhash64("fingerprint"))
    back = F.concat(*(F.substring(fp, k, 1) for k in range(bits // 8, 0, -1)))
    nodes, _ = common.materialise(keyed.groupBy("node", "fingerprint").agg(F.min("doc_id").alias("first")).select("node", back.alias("fp"), "first"), "mark-nodes")
    named = _classes(keyed, nodes, within(nodes, radius, bits))
    return keyed.join(named, "node").drop("node").withColumnRenamed("component_id", "near_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, _ = common.materialise(document_marks(common.table(spark, sf_dir, "documents")), "document-marks")
    return near_marks(marks)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(common.table(spark, sf_dir, "documents"))
    digits = F.hex("fp")
    big = F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2)))
    return found.select("doc_id", F.lower(big).alias("fingerprint"), "component_id")
