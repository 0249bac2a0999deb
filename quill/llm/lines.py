"""Line dedup: repeated runs of lines, by a suffix array over line ids from distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quill.llm import common
from quill.llm.rans import _arrow

#: Later copies of a repeated run of lines go if the run has at least so many words; shorter ones are counted.
MIN_WORDS = 50
_DOC = ["known", "doc", "tie"]
_LINES = "known int, doc long, tie long, i int, n int, high long, low long, ahead int, behind int"


def smallest_runs(words: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line, the lines of the smallest run of at least so many words that begins there, and of that which ends there.

    words has the lines' words and sizes the texts' lines; a run has a line at least, stays in its text, and is 0 where none is long enough.
    """
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    total = np.concatenate([[0], np.cumsum(words)])
    at = np.arange(len(words))
    stop = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), at + 1)
    start = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, at)
    return np.where(stop <= ends[text], stop - at, 0), np.where(start >= (ends - sizes)[text], at + 1 - start, 0)


def _split(batches: Iterable[pa.RecordBatch], least: int, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (known, doc, tie, text) as lines: place, ids of 128 bits, and the smallest runs ahead and behind."""
    for b in common.rows_of(batches):
        if not b.num_rows:
            continue
        split = [(t or "").split("\n") for t in b.column(3).to_pylist()]
        sizes = np.array([len(s) for s in split])
        every = [line for s in split for line in s]
        ids = np.frombuffer(b"".join(xxhash.xxh3_128_digest(line.encode()) for line in every), "<i8").reshape(-1, 2)
        ahead, behind = smallest_runs(np.array([len(line.split()) for line in every]), sizes, least)
        take = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        i = np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        columns = [i.astype("i4"), np.repeat(sizes, sizes).astype("i4"), ids[:, 0].copy(), ids[:, 1].copy(), ahead.astype("i4"), behind.astype("i4")]
        yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), *map(pa.array, columns)], schema=arrow)


def _ranked(keys: DataFrame, *cols: str) -> DataFrame:
    """Distinct keys with new, a number that follows their order: a sort over ranges, whose tasks number their own rows upwards."""
    ordered = keys.select(*cols).repartitionByRange(common.partitions(keys.sparkSession), *cols).sortWithinPartitions(*cols)
    return ordered.withColumn("new", F.monotonically_increasing_id() + 1)


def suffix_ranks(lines: DataFrame, depth: int) -> list[tuple[DataFrame, str]]:
    """Tables (known, doc, tie, i, n, rank), the k-th of the suffixes whose first 2 ** k lines stand elsewhere too.

    lines has known, doc, tie, i, n, high and low, a row a line. Rank orders the suffixes by those lines, equal ones alike: it
    is the suffix array to that depth, and suffixes of one rank are an interval of it whose common prefix has at least 2 ** k
    lines (or, at a text's end, all that are left). Ranks start as the order of the line ids. A round doubles the depth: a
    suffix's key is its rank and that of the suffix 2 ** k lines on (0 beyond the text), and the keys' order gives the new
    ranks. A suffix whose key is the only one is placed for good and leaves, as does one whose later half has left. Rounds
    end at the depth, or when none is left.

    Every round counts keys with partial sums, sorts distinct keys over ranges and joins them back, so that copies in a third
    of all rows are one key. Its table is written, and what it was made from isn't read again.
    """
    keys = lines.groupBy("high", "low").agg(F.count("*").alias("rows")).filter("rows > 1")
    ids, ids_at = common.materialise(_ranked(keys, "high", "low"), "line-ids")
    level = lines.join(ids, ["high", "low"]).select(*_DOC, "i", "n", F.col("new").alias("rank")).dropDuplicates([*_DOC, "i"])
    out, h = [common.materialise(level, "suffix-ranks")], 1
    common.discard(lines.sparkSession, ids_at)
    while 2 * h <= depth:
        on = F.first("rank").over(Window.partitionBy(*_DOC).orderBy("i").rangeBetween(h, h))
        pairs = out[-1][0].withColumn("next", F.when(F.col("i") + h < F.col("n"), on).otherwise(F.lit(0).cast("long"))).filter("next is not null")
        pairs, pairs_at = common.materialise(pairs, "suffix-pairs")
        again = pairs.groupBy("rank", "next").agg(F.count("*").alias("rows")).filter("rows > 1")
        order, order_at = common.materialise(_ranked(again, "rank", "next"), "suffix-order")
        new, new_at = common.materialise(pairs.join(order, ["rank", "next"]).select(*_DOC, "i", "n", F.col("new").alias("rank")), "suffix-ranks")
        common.discard(lines.sparkSession, pairs_at, order_at)
        if new.isEmpty():
            common.discard(lines.sparkSession, new_at)
            break
        out.append((new, new_at))
        h *= 2
    return out


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of repeated runs of lines, with n_lines, n_removed and n_repeated; a column n_chars follows the text.

    A run is one or more whole lines in a row. It is repeated if the same lines stand at an earlier place: in a document with
    a smaller doc_id (a null comes first), or earlier in the same document, with or without overlap. Every line that a
    repeated run of at least min_words words covers in a later copy goes; the first copy stays. n_repeated counts the lines
    that any repeated run covers in a later copy, whatever its words; with a min_words of 0 they all go. A text of which
    nothing is left is empty. Rows with equal doc_id and equal text count as one document and get one result; rows with equal
    doc_id and other texts come in an order of their texts' hashes. Null texts stay null, with 0 lines. Other columns stay as
    they are; columns named n_lines, n_removed or n_repeated are replaced. An empty table gives no rows.

    A maximal repeated run is the union of the smallest runs of min_words that begin at or end with its lines, so the suffix
    array is needed to the depth of the longest of those only. A smallest run of w lines is looked up as the interval of
    suffixes with a common prefix of at least w lines: those whose ranks at the depth 2 ** k next below agree at the run's
    begin and at its last 2 ** k lines. An interval's first place is summed up before the shuffle and joined back between
    written tables. No task sees more of a document than the document, or more of an interval than a share that adaptive
    execution can split. Texts move once, by document.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rest = docs.drop("n_lines", "n_removed", "n_repeated")
    doc, key = F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))
    rows = rest.select(doc.isNotNull().cast("int").alias("known"), F.coalesce(doc, F.lit(0)).alias("doc"), key.alias("tie"), F.col("text").cast("string").alias("text")).filter("text is not null")
    arrow = _arrow(_LINES)
    lines, at = common.materialise(rows.mapInArrow(lambda b: _split(b, min_words, arrow), _LINES), "lines")
    depth = lines.agg(F.max(F.greatest("ahead", "behind"))).first()[0] or 1
    levels = suffix_ranks(lines, depth)
    place = F.struct(*_DOC, "i")
    single = levels[0][0]
    early = single.groupBy("rank").agg(F.min(place).alias("first"))
    counted = single.join(early, "rank").filter(place > F.col("first")).groupBy(*_DOC).agg(F.count("*").alias("repeated"))
    runs = lines.filter("ahead > 0").select(*_DOC, "i", F.col("ahead").alias("w")).union(lines.filter("behind > 0").select(*_DOC, (F.col("i") - F.col("behind") + 1).alias("i"), F.col("behind").alias("w"))).distinct()
    runs = runs.withColumn("k", F.length(F.bin("w")) - 1)
    ranks = None
    for k, (table, _) in enumerate(levels):
        own = table.select(*_DOC, "i", F.lit(k).alias("k"), "rank")
        ranks = own if ranks is None else ranks.unionByName(own)
    begin = ranks.withColumnRenamed("rank", "a")
    end = ranks.select(*_DOC, F.col("i").alias("j"), "k", F.col("rank").alias("b"))
    named = runs.join(begin, [*_DOC, "i", "k"]).withColumn("j", F.col("i") + F.col("w") - F.expr("shiftleft(1, k)")).join(end, [*_DOC, "j", "k"]).select(*_DOC, "i", "w", "a", "b")
    held, held_at = common.materialise(named, "line-runs")
    first = held.groupBy("w", "a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last").select("w", "a", "b", "first")
    again, again_at = common.materialise(first, "line-repeats")
    later = held.join(again, ["w", "a", "b"]).filter(place > F.col("first"))
    spans = later.groupBy(*_DOC).agg(F.collect_set(F.struct(F.col("i").alias("start"), (F.col("i") + F.col("w")).alias("stop"))).alias("__spans"))
    found, _ = common.materialise(counted.join(spans, _DOC, "left"), "line-spans")
    common.discard(spark, at, held_at, again_at, *(x for _, x in levels))
    found = found.select(F.col("known").alias("__known"), F.col("doc").alias("__doc"), F.col("tie").alias("__tie"), "__spans", "repeated")
    # the same join at every size, so that what it moves grows with the texts
    on = (doc.isNotNull().cast("int") == F.col("__known")) & (F.coalesce(doc, F.lit(0)) == F.col("__doc")) & (F.col("__key") == F.col("__tie"))
    joined = rest.withColumn("__key", key).join(found.hint("merge"), on, "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda x, i: ~F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["stop"])))
    out = joined.withColumn("__lines", F.when(F.col("__spans").isNotNull(), kept))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_removed", F.when(F.col("__spans").isNull(), 0).otherwise(n - F.size("__lines")).cast("long"))
    out = out.withColumn("n_repeated", F.when(F.col("text").isNull(), 0).otherwise(F.coalesce("repeated", F.lit(0))).cast("long"))
    out = out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(F.array_join("__lines", "\n")))
    if "n_chars" in rest.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(rest.schema["n_chars"].dataType))
    return out.select(*rest.columns, "n_lines", "n_removed", "n_repeated")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
