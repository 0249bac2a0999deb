"""Language identification by a byte convolutional network, trained in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm import common
from quill.llm.rans import _arrow, _batch

#: The training sample: at most so many texts of each language, and windows of each text, spread evenly over it: so many on average, and at most.
TEXTS, WINDOWS, PIECES = 600, 4, 64
#: Bytes of a window, filters of each width, numbers for a byte.
WINDOW, FILTERS, EMBED = 192, 12, 8
WIDTHS = (2, 3, 4)
EPOCHS, BATCH, RATE = 5, 64, 0.004


def windows(raw: bytes, size: int = WINDOW) -> np.ndarray:
    """All of a text's bytes in rows of a window; the last is filled up with zeros."""
    n = max(1, -(-len(raw) // size))
    out = np.zeros(n * size, dtype=np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(n, size)


class ByteNet:
    """Byte embeddings, filters of several widths, the largest response in a window, one dense layer and softmax."""

    def __init__(self, labels: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.w = {"e": rng.normal(0, 0.5, (256, EMBED))}
        for k in WIDTHS:
            self.w[f"f{k}"] = rng.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS))
        self.w["d"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels)))
        self.w["b"] = np.zeros(len(labels))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _forward(self, x: np.ndarray):
        e = self.w["e"][x]
        pooled, kept = [], {}
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            cols = np.concatenate([e[:, j : j + n] for j in range(k)], axis=2)
            r = cols @ self.w[f"f{k}"]
            at = r.argmax(axis=1)
            pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0])
            kept[k] = (cols, at)
        p = np.concatenate(pooled, axis=1)
        h = np.maximum(p, 0)
        z = h @ self.w["d"] + self.w["b"]
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        return q / q.sum(axis=1, keepdims=True), h, p, kept

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> ByteNet:
        """Adam on cross-entropy; only the position of a filter's largest response gets its gradient."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for s in range(0, len(x), BATCH):
                own = order[s : s + BATCH]
                xb, yb = x[own], y[own]
                q, h, p, kept = self._forward(xb)
                dz = q.copy()
                dz[np.arange(len(yb)), yb] -= 1
                dz /= len(yb)
                g = {"d": h.T @ dz, "b": dz.sum(0), "e": np.zeros_like(self.w["e"])}
                dp = (dz @ self.w["d"].T) * (p > 0)
                for i, k in enumerate(WIDTHS):
                    cols, at = kept[k]
                    d = dp[:, i * FILTERS : (i + 1) * FILTERS]
                    best = cols[np.arange(len(yb))[:, None], at]  # texts, filters, inputs
                    g[f"f{k}"] = np.einsum("bfi,bf->if", best, d)
                    back = (d[:, :, None] * self.w[f"f{k}"].T[None]).reshape(len(yb), FILTERS, k, EMBED)
                    seen = xb[np.arange(len(yb))[:, None, None], at[:, :, None] + np.arange(k)]
                    np.add.at(g["e"], seen, back)
                step += 1
                for key, grad in g.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v2[key] = 0.999 * v2[key] + 0.001 * grad**2
                    self.w[key] -= (RATE * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Each filter's response to a pair of bytes at each pair of places, so that scoring is look-ups and sums."""
        e, out = self.w["e"], {}
        for k in WIDTHS:
            f = self.w[f"f{k}"].reshape(k, EMBED, FILTERS)
            one = [e @ f[j] for j in range(k)]
            out[k] = [(one[j][:, None] + (one[j + 1] if j + 1 < k else 0 * one[j])[None]).reshape(65536, FILTERS) for j in range(0, k, 2)]
        return out

    def log_probs(self, x: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        """Log probabilities of each window's languages."""
        wide = x.astype(np.int32)
        pair = np.empty(x.shape, dtype=np.int32)
        pair[:, :-1] = (wide[:, :-1] << 8) | wide[:, 1:]
        pair[:, -1] = wide[:, -1] << 8
        pooled = []
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            r = tables[k][0][pair[:, :n]]
            for j, t in enumerate(tables[k][1:], 1):
                r += t[pair[:, 2 * j : 2 * j + n]]
            pooled.append(r.max(axis=1))
        z = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.w["d"] + self.w["b"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def sample(docs: DataFrame, texts: int = TEXTS) -> dict[str, np.ndarray]:
    """Windows of the texts with a letter and of the smallest hashes, `texts` of each language or all, however large the others are.

    A text gives some windows spread evenly over it, the more the fewer texts its language has, but PIECES at most; they are
    cut where the text is, so that what reaches the driver is bounded by languages, texts and windows, not by long texts.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.filter((common.remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    common.ship(spark)
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    # eight deviations over what is wanted, so that a language's draws below its bound are enough
    share = texts + 8 * texts**0.5 + 20
    bounds = [(k, math.ceil(min(1.0, share / n) * (1 << 30)), max(1, min(PIECES, WINDOWS * texts // min(n, texts)))) for k, n in sizes.items()]
    limit = spark.createDataFrame(bounds, "lang string, most long, pieces int")
    part = rows.join(F.broadcast(limit), "lang").select("lang", "pieces", "text", "doc_id", "most", draw.alias("d")).filter("d < most")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("d", "doc_id", "text"))
    schema = "lang string, place int, cut binary"
    arrow = _arrow(schema)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            out = []
            for lang, at, pieces, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                own = windows(text.encode())
                own = own[np.unique(np.linspace(0, len(own) - 1, min(pieces, len(own))).astype(int))]
                out.append((lang, at, own.tobytes()))
            if out:
                yield _batch(out, arrow)

    found: dict[str, list[tuple]] = {}
    kept = part.withColumn("place", place).filter(F.col("place") <= texts).select("lang", "place", "pieces", "text")
    for r in kept.mapInArrow(cut, schema).toLocalIterator():
        found.setdefault(r["lang"], []).append((r["place"], bytes(r["cut"])))
    return {k: np.frombuffer(b"".join(raw for _, raw in sorted(v)), np.uint8).reshape(-1, WINDOW) for k, v in found.items()}


def train(docs: DataFrame, texts: int = TEXTS, seed: int = 1) -> ByteNet | None:
    """The network, from rows with a text and a lang whose crc32(doc_id) mod 5 isn't 0; None if there are no such rows.

    The sample is bounded: at most so many texts of each language, those of the smallest hashes, and a few windows of each.
    """
    found = sample(docs, texts)
    labels = sorted(found)
    if not labels:
        return None
    x = np.concatenate([found[label] for label in labels])
    return ByteNet(labels, seed).fit(x, np.repeat(np.arange(len(labels)), [len(found[label]) for label in labels]))


def predict(texts: list[str | None], net: ByteNet | None, tables: dict, chunk: int = 1024) -> list[tuple[str, float]]:
    """Language and probability of each whole text: all its windows count, by their bytes against its fullest one's."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    known = [k for k, t in enumerate(texts) if t and net and has_letter(t)]
    if not known:
        return out
    rows = [windows(texts[k].encode()) for k in known]
    x = np.concatenate(rows)
    p = np.concatenate([net.log_probs(x[s : s + chunk], tables) for s in range(0, len(x), chunk)])
    starts = np.cumsum([0, *map(len, rows)])[:-1]
    filled = (x > 0).sum(axis=1)
    p *= (filled / np.repeat(np.maximum(1, np.maximum.reduceat(filled, starts)), [len(r) for r in rows]))[:, None]
    z = np.add.reduceat(p, starts, axis=0)
    z -= z.max(axis=1, keepdims=True)
    q = np.exp(z)
    q /= q.sum(axis=1, keepdims=True)
    for k, row in zip(known, q, strict=True):
        best = int(row.argmax())
        out[k] = (net.labels[best], float(row[best]))
    return out


_nets: dict[str, tuple] = {}


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """docs with lang_pred and lang_score of each whole text; columns of these names are replaced.

    A null text, or one without a letter, is `und` with score 0, as is every text if there was nothing to learn from. Other
    rows and columns stay as they are. The network goes to the tasks with the code: a few hundred thousand numbers at most.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructType

    common.ship(docs.sparkSession)
    rest = docs.drop("lang_pred", "lang_score")
    schema = StructType([*rest.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType())
    arrow = to_arrow_schema(schema)
    at = rest.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else {}
        for b in common.rows_of(batches):
            found = predict(b.column(at).to_pylist(), net, tables)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], schema=arrow)

    return rest.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
