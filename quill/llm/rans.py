"""Token files under a static range asymmetric numeral system with one shared frequency table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common
from quill.llm.word_ids import encoder

#: Frequencies sum to 2 ** SCALE; a lane's state stays in [2 ** 31, 2 ** 63) and moves 32 bits at a time.
SCALE = 20
LOW = np.uint64(1 << 31)
LANES = 1024
BLOCK = 1 << 18
#: Steps of a block between two checkpoints.
EVERY = 128
SHARD = 1 << 19
MAGIC = b"QRN1"
_S, _M, _W = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)


class Table:
    """Frequencies of symbols, out of 2 ** SCALE; every symbol that was counted has at least one."""

    def __init__(self, counts: np.ndarray):
        counts = np.asarray(counts, dtype=np.float64)
        if (counts > 0).sum() > 1 << SCALE:
            raise ValueError("more symbols than the table has places")
        total = max(counts.sum(), 1)
        f = np.floor(counts * ((1 << SCALE) / total)).astype(np.int64)
        f[(counts > 0) & (f == 0)] = 1
        if not f.any():
            f = np.ones(1, dtype=np.int64)
        f[np.argmax(f)] += max(0, (1 << SCALE) - f.sum())
        while (over := f.sum() - (1 << SCALE)) > 0:
            k = np.argmax(f)
            f[k] -= min(over, max(1, f[k] // 2))
        self.freq = f.astype(np.uint64)
        self.first = (np.cumsum(f) - f).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(f), dtype=np.uint32), f)
        self.digest = zlib.crc32(f.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = EVERY) -> bytes:
    """One independent block: lane j takes symbols j, j + lanes, ...; the header has its checksum, the states to start from and checkpoints."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    for t in range(steps - 1, -1, -1):
        s = ids[t * lanes : (t + 1) * lanes]
        own, f = x[: len(s)], table.freq[s]
        over = own >= (f << np.uint64(43))
        out = own[over]
        words.append((out & np.uint64(0xFFFFFFFF)).astype("<u4"))
        written += len(out)
        own[over] = out >> _W
        q = own // f
        own[:] = (q << _S) + (own - q * f) + table.first[s]
        if t and t % every == 0:
            marks.append((t, written, x.astype("<u8").tobytes()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    head = struct.pack("<IIIII", n, lanes, len(stream), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
    points = b"".join(struct.pack("<II", t, len(stream) - w) + states for t, w, states in reversed(marks))
    return head + x.astype("<u8").tobytes() + points + stream.tobytes()


def decode_block(raw: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The block's symbols, from its start (with its checksum tested) or from its k-th checkpoint on."""
    n, lanes, size, marks, crc = struct.unpack_from("<IIIII", raw)
    at = 20 + 8 * lanes
    begin, pos = 0, 0
    x = np.frombuffer(raw, "<u8", lanes, 20).astype(np.uint64)
    if checkpoint:
        k = at + (checkpoint - 1) * (8 + 8 * lanes)
        begin, pos = struct.unpack_from("<II", raw, k)
        x = np.frombuffer(raw, "<u8", lanes, k + 8).astype(np.uint64)
    stream = np.frombuffer(raw, "<u4", size, at + marks * (8 + 8 * lanes)).astype(np.uint64)
    out = np.empty(n, dtype="<u4")
    for t in range(begin, -(-n // lanes)):
        k = min(lanes, n - t * lanes)
        own = x[:k]
        slot = own & _M
        s = table.symbol[slot]
        own[:] = table.freq[s] * (own >> _S) + slot - table.first[s]
        low = own < LOW
        m = int(low.sum())
        own[low] = (own[low] << _W) | stream[pos : pos + m]
        pos += m
        out[t * lanes : t * lanes + k] = s
    if (x != LOW).any() or not checkpoint and zlib.crc32(out.tobytes()) != crc:
        raise ValueError("a block's checksum is wrong")
    return out[begin * lanes :]


def write_shard(lengths: np.ndarray, ids: np.ndarray, table: Table, block: int = BLOCK) -> bytes:
    """A file of documents: magic, the table's digest, an index of blocks, the documents' lengths, the header's checksum, blocks."""
    blocks = [encode_block(ids[k : k + block], table) for k in range(0, len(ids), block)]
    sizes = np.array([len(b) for b in blocks], dtype="<u4").tobytes()
    head = MAGIC + struct.pack("<III", table.digest, len(blocks), len(lengths)) + sizes + lengths.astype("<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(blocks)


def shard_index(raw: bytes, table: Table) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Documents' lengths, and where each block is; any block can be decoded alone."""
    if raw[:4] != MAGIC:
        raise ValueError("not a token file")
    digest, blocks, docs = struct.unpack_from("<III", raw, 4)
    at = 16 + 4 * (blocks + docs)
    if zlib.crc32(raw[:at]) != struct.unpack_from("<I", raw, at)[0] or digest != table.digest:
        raise ValueError("a token file's header is damaged, or another table wrote it")
    ends = at + 4 + np.cumsum(np.frombuffer(raw, "<u4", blocks, 16).astype(np.int64))
    starts = [at + 4, *ends[:-1].tolist()] if blocks else []
    return np.frombuffer(raw, "<u4", docs, 16 + 4 * blocks), list(zip(starts, ends.tolist(), strict=True))


def read_shard(raw: bytes, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Documents' lengths, and all ids in turn."""
    lengths, where = shard_index(raw, table)
    return lengths, np.concatenate([np.empty(0, "<u4"), *(decode_block(raw[a:b], table) for a, b in where)]).astype("<u4")


_STAGED = "part int, shard int, first long, n_tokens long, doc_ids array<long>, lengths array<long>, body binary, counts binary"
_FILES = "part int, shard int, first long, n_tokens long, doc_ids array<long>, body binary"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
_IDS = "doc_id long, start long, ids array<long>"


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def _stage(batches: Iterable[pa.RecordBatch], path: str, end: int, shard: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A task's documents in shards of about so many ids, and last its counts of ids."""
    from pyspark import TaskContext

    part, ids = TaskContext.get().partitionId(), encoder(path)
    last, press = np.array([end], dtype=ids.dtype).tobytes(), zstandard.ZstdCompressor(level=3)
    counts = np.zeros(max(ids.vocab_size, end + 1), dtype=np.int64)
    docs, found, size, number, first = [], [], 0, 0, 0

    def shut() -> pa.RecordBatch:
        raw = b"".join(found)
        np.add(counts, np.bincount(np.frombuffer(raw, ids.dtype), minlength=len(counts)), out=counts)
        width = ids.dtype.itemsize
        return _batch([(part, number, first, len(raw) // width, docs, [len(x) // width for x in found], press.compress(raw), None)], arrow)

    for some in common.rows_of(batches):
        for doc, raw in zip(some.column(0).to_pylist(), ids.encode(some.column(1).to_pylist()), strict=True):
            docs.append(doc)
            found.append(raw + last)
            size += len(found[-1]) // ids.dtype.itemsize
            if size >= shard:
                yield shut()
                docs, found, size, number, first = [], [], 0, number + 1, first + size
    if docs:
        yield shut()
    if counts.any():
        yield _batch([(part, -1, 0, 0, None, None, None, press.compress(counts.astype("<i8").tobytes()))], arrow)


def _counted(batches: Iterable[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for raw in b.column(0).to_pylist():
            one = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8")
            total = one if total is None else total + one
    if total is not None:
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype("i4")), pa.array(total[k])], schema=arrow)


def _press(batches: Iterable[pa.RecordBatch], counts: np.ndarray, dtype: str, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = Table(counts)
    for some in common.rows_of(batches, 8, 64 << 20):
        rows = []
        for r in some.to_pylist():
            ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["body"], max_output_size=r["n_tokens"] * np.dtype(dtype).itemsize), dtype)
            rows.append((r["part"], r["shard"], r["first"], r["n_tokens"], r["doc_ids"], write_shard(np.array(r["lengths"]), ids.astype("<u4"), table)))
        yield _batch(rows, arrow)


def _read(batches: Iterable[pa.RecordBatch], counts: np.ndarray, base: dict[int, int], whole: bool, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = Table(counts)
    for some in common.rows_of(batches, 4, 16 << 20):
        for r in some.to_pylist():
            lengths, ids = read_shard(r["body"], table)
            at, rows = 0, []
            for doc, n in zip(r["doc_ids"], lengths.tolist(), strict=True):
                own = ids[at : at + n]
                rows.append((doc, base[r["part"]] + r["first"] + at, own if whole else n) + (() if whole else (zlib.crc32(own.tobytes()),)))
                at += n
                if len(rows) == 4096:
                    yield _batch(rows, arrow)
                    rows = []
            if rows:
                yield _batch(rows, arrow)


class TokenFile:
    """A written corpus: a table of self-contained shard files, the shared counts, and the ids before each part."""

    def __init__(self, files: DataFrame, at: str, counts: np.ndarray, base: dict[int, int]):
        self.files, self.at, self.counts, self.base = files, at, counts, base

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens and ids_crc32 of each document, from its decoded ids."""
        counts, base, arrow = self.counts, self.base, _arrow(_READ)
        return self.files.mapInArrow(lambda b: _read(b, counts, base, False, arrow), _READ)

    def documents(self) -> DataFrame:
        """doc_id, start and ids of each document."""
        counts, base, arrow = self.counts, self.base, _arrow(_IDS)
        return self.files.mapInArrow(lambda b: _read(b, counts, base, True, arrow), _IDS)


def write(docs: DataFrame, path: str, end: int, shard: int = SHARD) -> TokenFile:
    """All documents' ids, each document closed by the id end, in ascending doc_id order.

    docs needs doc_id and text; other columns are ignored, whatever their names. Null texts are empty; a null doc_id comes
    first; rows with the same doc_id follow each other in an order of their texts' hashes, so that one doc_id may hold any
    share of the rows. An empty table gives a file of no shards.

    One shuffle puts the texts in order. Each task encodes its share once, into staged shards and its counts of ids. The
    counts' sum has at most the vocabulary's size, and is the one table that every block is coded with. The ids before each
    part are sums by part, as many numbers as there are tasks. Blocks need nothing but the table, so they're read in parallel.
    Spark has no sink for bare binary files, so a shard file's bytes are a row of a Parquet table in the shared folder.
    """
    spark = docs.sparkSession
    common.ship(spark)
    staged, files = _arrow(_STAGED), _arrow(_FILES)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = common.key_order(rows, "doc_id", "tie").select("doc_id", "text")
    kept, staging = common.materialise(ordered.mapInArrow(lambda b: _stage(b, path, end, shard, staged), _STAGED), "staged")
    summed = _arrow("id int, n long")
    found = kept.filter("counts is not null").select("counts").mapInArrow(lambda b: _counted(b, summed), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max([0, *(r["id"] for r in found)]), dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    dtype = encoder(path).dtype.str
    shards = kept.filter("shard >= 0").drop("counts")
    out, at = common.materialise(shards.mapInArrow(lambda b: _press(b, counts, dtype, files), _FILES), "token-file")
    common.discard(spark, staging)
    base, before = {}, 0
    for r in sorted(out.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r["part"]] = before
        before += r["n"]
    return TokenFile(out, at, counts, base)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(common.table(spark, sf_dir, "documents"), f"{common.TOKENIZERS}/word_bpe_49k.json", 1).digests()
