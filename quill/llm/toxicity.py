"""Toxicity by weak supervision: voters, a generative label model over them, and a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.llm import common

#: The training sample: at most so many labelled rows of each class.
ROWS = {1: 2000, 0: 3000}
VOTERS, TERMS = 64, 3000
#: The least log likelihood ratio of the classifier's terms and, about one in a million by chance, of the voters' learned lexicons; the least correlation that counts.
GAIN, SURE_GAIN, MOVES_ALONG = 6.0, 12.0, 0.3
PREFIXES = (4, 5, 6)
#: A longer text of the sample is learned from by pieces spread evenly over it, so many characters together.
CHARS, PIECES = 24_000, 16
#: Plain insults, a lexicon for each language, and words by which someone is spoken to.
INSULTS = {
    "en": ("idiot", "moron", "stupid", "dumb", "pathetic", "loser", "clown", "trash", "garbage", "scum", "worthless", "disgusting", "fool", "hate", "shut"),
    "de": ("idiot", "dumm", "blöd", "trottel", "arschloch", "abschaum", "erbärmlich", "widerlich", "versager", "müll", "hasse"),
    "fr": ("idiot", "imbécile", "stupide", "crétin", "débile", "pathétique", "ordure", "minable", "nul", "dégoûtant", "déteste"),
    "es": ("idiota", "imbécil", "estúpido", "tonto", "basura", "patético", "inútil", "asco", "payaso", "escoria", "odio"),
}
ADDRESSED = ("you", "your", "du", "dein", "ihr", "tu", "ton", "vous", "votre", "tú", "eres", "usted")
#: Signs and digits that stand for letters.
STANDS_FOR = str.maketrans("013457@$!", "oieastasi")
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000


def terms(text: str) -> set[str]:
    """The distinct lower-case words of a text, and the beginnings of longer ones (with a trailing hyphen)."""
    words = set(_WORD.findall(text.lower()))
    return words | set(chain.from_iterable((w[:k] + "-" for k in PREFIXES if len(w) > k) for w in words))


def lexicon(found: list[set[str]], y: np.ndarray, most: int, least: float = GAIN) -> list[str]:
    """The terms that tell the toxic rows apart beyond chance: by the likelihood ratio of their share there against elsewhere."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    one, zero = Counter(chain.from_iterable(t for t, k in zip(found, y, strict=True) if k)), Counter(chain.from_iterable(t for t, k in zip(found, y, strict=True) if not k))
    share, gain = n1 / (n1 + n0), {}
    for t, c in one.items():
        p = c / (c + zero[t])
        if p > share:
            g = c * np.log(p / share) + (zero[t] * np.log((1 - p) / (1 - share)) if zero[t] else 0)
            if g >= least:
                gain[t] = g
    return sorted(gain, key=lambda t: (-gain[t], t))[:most]


def families(found: list[set[str]], names: list[str], most: int) -> list[list[str]]:
    """Terms that stand in nearly the same rows make one voter's lexicon: a word with its beginnings, mostly."""
    rows = {t: set() for t in names}
    for k, f in enumerate(found):
        for t in f & rows.keys():
            rows[t].add(k)
    out: list[tuple[set[int], list[str]]] = []
    for t in names:
        for own, terms_ in out:
            if len(own & rows[t]) >= 0.8 * len(own | rows[t]):
                terms_.append(t)
                break
        else:
            if len(out) < most:
                out.append((rows[t], [t]))
    return [t for _, t in out]


_PLAIN = rf"\b(?:{'|'.join(sorted({re.escape(w) for ws in INSULTS.values() for w in ws}, key=lambda w: (-len(w), w)))})s?\b"
_SAID = rf"\b(?:{'|'.join(ADDRESSED)})\b"
_ADDRESS = re.compile(rf"{_SAID}\W+(?:\w+\W+){{0,3}}?{_PLAIN}|{_PLAIN}\W+(?:\w+\W+)?{_SAID}", re.I)
_HIDDEN = re.compile(r"\b[^\W\d_]*[013457@$!][^\W_]*[^\W\d_]\w*")
_DRAWN = re.compile(r"\b(?=\w*?(\w)\1\1)\w+")
_TWICE = re.compile(rf"{_PLAIN}.*{_PLAIN}", re.I | re.S)
_LOUD = re.compile(rf"{_PLAIN}\W{{0,2}}!", re.I)
_ANY = re.compile(_PLAIN, re.I)


def _hidden(text: str) -> bool:
    """Whether a word becomes an insult once signs and digits are read as letters, or long-drawn letters as one."""
    return any(_ANY.match(m[0].lower().translate(STANDS_FOR)) for m in _HIDDEN.finditer(text)) or any(_ANY.match(re.sub(r"(\w)\1\1+", r"\1", m[0].lower())) for m in _DRAWN.finditer(text))


def votes(texts: list[str], found: list[set[str]], lexicons: list[list[str]]) -> np.ndarray:
    """1: toxic, 0: not, -1: abstains; a row a text, a column a voter.

    A lexicon votes 1 if one of its terms is there and abstains otherwise: the given ones by language, then the learned ones.
    Patterns over the text vote 1 and abstain alike: an insult beside a word of address, a hidden or long-drawn insult, two
    insults, a loud one. One voter speaks for clean texts, if no learned lexicon has a hit, so that given ones may be outvoted.
    """
    given = [{w for w in ws} for ws in INSULTS.values()]
    out = np.full((len(texts), len(given) + len(lexicons) + 5), -1, dtype=np.int8)
    for k, (text, f) in enumerate(zip(texts, found, strict=True)):
        words = set(_WORD.findall(text.lower()))
        hits = [bool(words & g) for g in given] + [any(t in f for t in w) for w in lexicons]
        hits += [bool(_ADDRESS.search(text)), _hidden(text), bool(_TWICE.search(text)), bool(_LOUD.search(text))]
        out[k, : len(hits)][hits] = 1
        if not any(hits[len(given) : len(given) + len(lexicons)]):
            out[k, -1] = 0
    return out


class LabelModel:
    """How often each voter votes either way in either class, and how much voters repeat each other within a class.

    EM starts at the majority of the votes cast, or at given guesses of the rows' classes, and then sees the votes and the
    classes' balance only: it estimates each voter's rates of 1, 0 and abstaining in either class (its accuracy follows from
    them), and the voters' correlations given the class. A vote's say in a row is divided by the sum of its voter's
    correlations with the voters that speak there, so that voters that move together don't count as independent. Abstaining
    says nothing. As most voters vote one way only, each round holds the posteriors' mean to the balance.
    """

    def __init__(self, v: np.ndarray, balance: float, guess: np.ndarray | None = None, rounds: int = 10):
        one, zero = (v == 1).astype(float), (v == 0).astype(float)
        x = one - zero
        lean = x.sum(axis=1)
        q = np.where(lean > 0, 0.9, np.where(lean < 0, 0.1, 0.5)) if guess is None else 0.02 + 0.96 * guess
        balance = min(max(balance, 1e-3), 1 - 1e-3)
        for _ in range(rounds):
            self.rates = [[(part.T @ w + 0.2) / (w.sum() + 0.6) for part in (one, zero, 1 - one - zero)] for w in (1 - q, q)]
            clean, toxic = (r[0] - r[1] for r in self.rates)
            r = x - np.outer(1 - q, clean) - np.outer(q, toxic)
            r /= np.sqrt((r**2).mean(axis=0)) + 1e-6
            self.corr = r.T @ r / max(1, len(v))
            self.alike = np.where(np.abs(self.corr) > MOVES_ALONG, np.abs(self.corr), 0)
            np.fill_diagonal(self.alike, 1.0)
            low, high = -40.0, 40.0
            for _ in range(50):
                self.bias = (low + high) / 2
                q = self.posterior(v)
                low, high = (self.bias, high) if q.mean() < balance else (low, self.bias)
        (c1, c0, _), (t1, t0, _) = self.rates
        self.accuracy = (balance * t1 + (1 - balance) * c0) / (balance * (t1 + t0) + (1 - balance) * (c1 + c0))

    def says(self, v: np.ndarray) -> np.ndarray:
        """The say of each voter's vote in each row, from 0 (abstains) to 1."""
        cast = (v >= 0).astype(float)
        return cast / np.maximum(1, cast @ self.alike)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        says, z = self.says(v), np.full(len(v), self.bias)
        for kind, a, b in zip((1, 0), *self.rates):  # noqa: B905 - the third rate is abstaining
            z += ((v == kind) * says) @ np.log(b / a)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Classifier:
    """Logistic regression on terms, as a bias and a weight for each term."""

    def __init__(self, bias: float, weights: dict[str, float]):
        self.bias, self.weights = bias, weights
        self.known: dict[str, tuple[str, ...]] = {}

    @classmethod
    def fit(cls, found: list[set[str]], target: np.ndarray, weight: np.ndarray, names: list[str], rounds: int = 300) -> Classifier:
        at = {t: k for k, t in enumerate(names)}
        own = [sorted(at[t] for t in f & at.keys()) for f in found]
        row, col = np.repeat(np.arange(len(found)), [len(k) for k in own]), np.array([k for ks in own for k in ks], dtype=int)
        w, b = np.zeros(len(names)), 0.0
        m, v, step = np.zeros(len(names) + 1), np.zeros(len(names) + 1), 0.05
        weight = weight / weight.sum()
        for k in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(found)) + b, -30, 30)))
            d = (p - target) * weight
            g = np.append(np.bincount(col, d[row], len(names)) + 1e-5 * w, d.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            change = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
            w, b = w - change[:-1], b - change[-1]
        return cls(float(b), {t: float(x) for t, x in zip(names, w, strict=True) if abs(x) > 1e-3})

    def score(self, text: str | None) -> float:
        known, seen = self.known, set()
        for w in set(_WORD.findall((text or "").lower())):
            hit = known.get(w)
            if hit is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                hit = known[w] = tuple(t for t in (w, *(w[:k] + "-" for k in PREFIXES if len(w) > k)) if t in self.weights)
            if hit:
                seen.update(hit)
        z = self.bias + sum(map(self.weights.__getitem__, sorted(seen)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None) -> Classifier:
    """The classifier, from labelled rows whose crc32(doc_id) mod 4 isn't 2; a constant score of 0 if there are none.

    The sample is bounded: at most so many rows of each class, by the smallest hashes of doc_id. Of repeated ids the smallest
    text counts. The labels give
    some of the voters' lexicons and the classes' balance, and no more: the label model turns votes into posteriors without them, and those are what
    the classifier learns from. Rows count so that the classes have their shares among all labelled rows. A text over CHARS
    characters is learned from by pieces spread over it (scoring reads whole texts). Labels that aren't 0 or 1, null ids and null texts
    teach nothing.
    """
    spark, rows = docs.sparkSession, rows or ROWS
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.filter((common.remainder("doc_id", 4) != 2) & F.col("toxic").isin(0, 1)).distinct()
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1):
        return Classifier(-30.0, {})
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    most = F.when(F.col("toxic") == 1, F.lit(int(min(1.0, rows[1] / sizes[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, rows[0] / max(1, sizes.get(0, 0))) * (1 << 30))))
    ids = known.filter(draw < most)
    text = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter("text is not null")
    bound, order = 2 * sum(rows.values()), (draw, "doc_id", "toxic")
    one = text.join(F.broadcast(ids.orderBy(*order).limit(bound)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    size = F.length("text")
    spread = F.concat_ws(" ", *(F.substring(F.col("text"), F.floor(size * k / PIECES).cast("int") + 1, F.lit(CHARS // PIECES)) for k in range(PIECES)))
    sample = one.withColumn("text", F.when(size <= CHARS, F.col("text")).otherwise(spread)).orderBy(*order).limit(bound)
    texts = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.collect())
    y = np.array([t[2] for t in texts], dtype=int)
    if not y.any():
        return Classifier(-30.0, {})
    # terms of fewer toxic rows can't be sure of anything; without them the sample's terms take little memory
    often = Counter(chain.from_iterable(terms(text) for _, text, toxic in texts if toxic))
    often = {t: t for t, n in often.items() if n >= 3}
    found = [{often[t] for t in terms(text) if t in often} for _, text, _ in texts]
    names = lexicon(found, y, TERMS)
    v = votes([text for _, text, _ in texts], found, families(found, lexicon(found, y, TERMS, SURE_GAIN), VOTERS))
    target = LabelModel(v, float(y.mean())).posterior(v)
    total = sum(sizes.values())
    weight = np.where(y == 1, sizes[1] / total / max(1, y.sum()), sizes.get(0, 0) / total / max(1, (1 - y).sum()))
    return Classifier.fit(found, target, weight, names)


def rate(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with toxic_score of each whole text (a column of that name is replaced); null and empty texts get the score of no terms."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructType

    common.ship(docs.sparkSession)
    rest = docs.drop("toxic_score")
    schema = StructType([*rest.schema.fields]).add("toxic_score", DoubleType())
    arrow = to_arrow_schema(schema)
    at = rest.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.rows_of(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([model.score(t) for t in b.column(at).to_pylist()], pa.float64())], schema=arrow)

    return rest.mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rate(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", (common.remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))
