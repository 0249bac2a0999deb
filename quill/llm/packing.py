"""Packing token sequences into windows by minimum bin slack."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quill.llm import common
from quill.llm.word_ids import encoder

CAPACITY = 4096
#: Rests that wait for a window at most, in each task; each is shorter than a window.
POOL = 1536
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def best_fill(lengths: Counter[int], room: int) -> dict[int, int]:
    """How many of each length to take for the sum closest to room from below; ties go to longer lengths.

    Bits of an integer are the sums reached so far. A length with a count enters as multiples 1, 2, 4, ... of itself, so
    that any number up to its count can be taken; the search ends as soon as room itself is reached, and the sums' history
    gives the counts back.
    """
    mask = (1 << (room + 1)) - 1
    full = 1 << room
    reached = 1
    history: list[tuple[int, int, int]] = []
    for length in sorted((x for x in lengths if x <= room), reverse=True):
        left, step = min(lengths[length], room // length), 1
        while left:
            take = min(step, left)
            after = (reached | (reached << (length * take))) & mask
            if after != reached:
                history.append((length, take, reached))
                reached = after
                if reached & full:
                    break
            left -= take
            step *= 2
        if reached & full:
            break
    rest = reached.bit_length() - 1
    taken: dict[int, int] = {}
    for length, take, before in reversed(history):
        if not before >> rest & 1:
            taken[length] = taken.get(length, 0) + take
            rest -= length * take
    return taken


class Packer:
    """Pieces of one task's documents in sequences of at most capacity ids; sequence ids count up from first."""

    def __init__(self, first: int, capacity: int = CAPACITY, pool: int = POOL, size: int = 4):
        self.capacity, self.pool, self.size, self.next = capacity, pool, size, first
        self.rests: dict[int, list[tuple]] = {}
        self.count: Counter[int] = Counter()
        self.waiting = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // self.size
            wide = ids if self.size == 4 else np.frombuffer(ids, f"<u{self.size}").astype("<u4").tobytes()
            self.out.append((doc, start, n, zlib.crc32(wide), total, self.next, at))
            at += n
        self.next += 1

    def _wait(self, piece: tuple) -> None:
        n = len(piece[2]) // self.size
        self.rests.setdefault(n, []).append(piece)
        self.count[n] += 1
        self.waiting += 1

    def _pop(self, n: int) -> tuple:
        piece = self.rests[n].pop()
        self.count[n] -= 1
        self.waiting -= 1
        if not self.rests[n]:
            del self.rests[n], self.count[n]
        return piece

    def add(self, doc: int | None, ids: bytes) -> None:
        """Whole windows of a document go out at once, its rest waits."""
        total, step = len(ids) // self.size, self.capacity * self.size
        whole = len(ids) // step * step
        for k in range(0, whole, step):
            self._emit([(doc, k // self.size, ids[k : k + step], total)])
        if whole < len(ids):
            self._wait((doc, whole // self.size, ids[whole:], total))
        while self.waiting > self.pool:
            self._window()

    def _window(self) -> int:
        """One window around the longest rest; its slack."""
        first = self._pop(max(self.count))
        pieces, room = [first], self.capacity - len(first[2]) // self.size
        if room:
            for n, k in best_fill(self.count, room).items():
                pieces += [self._pop(n) for _ in range(k)]
                room -= n * k
        if room and self.waiting:  # no multiset fills it: cut the shortest rest that is longer
            n = min(n for n in self.count if n > room)
            doc, start, ids, total = self._pop(n)
            pieces.append((doc, start, ids[: room * self.size], total))
            self._wait((doc, start + room, ids[room * self.size :], total))
            room = 0
        if room:  # the last one: cut at powers of two, which need no padding
            self._powers(pieces)
        else:
            self._emit(pieces)
        return room

    def _powers(self, pieces: list[tuple]) -> None:
        left = sum(len(p[2]) for p in pieces) // self.size
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            now = []
            while room:
                doc, start, ids, total = pieces.pop(0)
                n = min(room, len(ids) // self.size)
                now.append((doc, start, ids[: n * self.size], total))
                if n * self.size < len(ids):
                    pieces.insert(0, (doc, start + n, ids[n * self.size :], total))
                room -= n
            self._emit(now)

    def finish(self) -> None:
        while self.waiting:
            self._window()

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def _packed(batches: Iterable[pa.RecordBatch], path: str, end: int, capacity: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ids = encoder(path)
    last = np.array([end], dtype=ids.dtype).tobytes()
    packer = Packer(TaskContext.get().partitionId() << 40, capacity, size=ids.dtype.itemsize)

    def ready() -> Iterator[pa.RecordBatch]:
        if rows := packer.take():
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    for part in common.rows_of(batches):
        for doc, raw in zip(part.column(0).to_pylist(), ids.encode(part.column(1).to_pylist()), strict=True):
            packer.add(doc, raw + last)
        yield from ready()
    packer.finish()
    yield from ready()


def pack(docs: DataFrame, path: str, end: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents' ids, each document closed by the id end, in sequences of at most capacity ids.

    docs needs doc_id and text; other columns are ignored, whatever their names. Each task packs what it reads, in one pass
    and with no shuffle, so memory is bounded by the pool of waiting rests. Documents longer than a window are cut into
    whole windows and a rest. Rests wait in the pool; each window takes the longest rest and the multiset of others that
    comes closest to filling it. When a window can't be filled exactly, a longer rest is cut to fill it. A task's last ids
    go to sequences whose lengths are powers of two, so that nothing is padded.

    Null and empty texts give a document of the id end alone. Repeated rows are documents of their own. An empty table gives
    no rows. A null doc_id stays null. sequence_id is unique; each task counts from its own base.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    common.ship(docs.sparkSession)
    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(lambda b: _packed(b, path, end, capacity, arrow), SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), f"{common.TOKENIZERS}/word_bpe_49k.json", 2)
