"""Quality selection by importance resampling over hashed n-grams.

Two bags of hashed unigrams and bigrams, one of the target rows and one of all rows, give each document the logarithm of
its importance weight: the sum over its n-grams of the log ratio of the two models. Gumbel noise on those,
hashed from the doc_id, turns "the k largest" into a draw of k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, free_names, join_few, kth_largest, materialise, no_smaller, releasing

CELLS = 1 << 15
SMOOTHING = 0.5
TOKEN = re.compile(rb"[a-z0-9_\x80-\xff]+|[^a-z0-9_\x80-\xff]+")


class Tokens(dict):
    """A word's tokens (runs of letters and digits, runs of other signs) as hashes, remembered up to a bound."""

    LIMIT = 1 << 17

    def __missing__(self, word: bytes) -> list[int]:
        out = [zlib.crc32(t) for t in TOKEN.findall(word)]
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = out
        return out


def ngram_cells(text: bytes | None, tokens: Tokens) -> np.ndarray:
    """Cells of every unigram and bigram of the whole text."""
    ids = np.fromiter(chain.from_iterable(map(tokens.__getitem__, (text or b"").lower().split())), dtype=np.uint64)
    pairs = ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([ids * np.uint64(0xD6E8FEB86659FD93), pairs * np.uint64(0xD6E8FEB86659FD93)])
    return (both >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def ngram_counts(rows: DataFrame) -> np.ndarray:
    """Counts of the cells, over all rows: (2, CELLS), of all rows and of those whose ``target`` is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, total = Tokens(), np.zeros((2, CELLS), dtype=np.int64)
        for b in batches:
            for text, target in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("target").to_pylist(), strict=True):
                n = np.bincount(ngram_cells(text, tokens), minlength=CELLS)
                total[0] += n
                if target:
                    total[1] += n
        cells = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[0][cells]), pa.array(total[1][cells])], ["cell", "n", "t"])

    out = np.zeros((2, CELLS), dtype=np.int64)
    found = rows.select("text", "target").mapInArrow(releasing(run), "cell long, n long, t long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toPandas()
    out[0, found["cell"]], out[1, found["cell"]] = found["n"], found["t"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of the target model's probability over the raw model's, of each cell; zeros without any target row."""
    if not counts[1].sum():
        return np.zeros(CELLS)
    p = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * CELLS)
    return np.log(p[1]) - np.log(p[0])


def with_log_weight(rows: DataFrame, ratios: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """keep and ``log_weight``; a text without words weighs 0."""
    shared = rows.sparkSession.sparkContext.broadcast(ratios)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, table = Tokens(), shared.value
        for b in batches:
            w = [float(table[ngram_cells(t, tokens)].sum()) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(w, pa.float64())], [*keep, "log_weight"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "log_weight double"])
    return rows.select(*keep, "text").mapInArrow(releasing(run), schema)


def marked(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), most_broadcast: int = 1_000_000) -> DataFrame:
    """doc_id, text, quality (of the labels, null without one) and target (quality 1 and not toxic).

    Labels are one row a document: of several for one doc_id, the worst counts. Labels up to
    ``most_broadcast`` rows are broadcast, so the texts stay where they are; of more, only texts that may be labelled move.
    """
    d, = free_names(docs, "d")
    own = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(d)).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    own = materialise(own.where(F.col("quality").isNotNull()), "labels")
    joined = join_few(docs.select("doc_id", "text", *keep), own, "doc_id", d, most_broadcast)
    target = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    return joined.select("doc_id", "text", *keep, "quality", target.alias("target"))


def acceptance_cut(scored: DataFrame) -> float:
    """The log weight that best tells good labelled documents from bad, the mean of both error rates least.

    From a histogram of weights to one part in sixteen of their size (at most a few hundred cells), over all labelled rows. Without
    labels of both kinds, no document is below the cut.
    """
    w = F.col("log_weight")
    cell = F.round(F.signum(w) * F.log1p(F.abs(w)) * 16).cast("int")
    found = scored.where(F.col("quality").isNotNull()).groupBy(cell.alias("c")).agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"), F.sum((F.col("quality") != 1).cast("long")).alias("bad")).orderBy("c").collect()
    good, bad = sum(r["good"] for r in found), sum(r["bad"] for r in found)
    if not good or not bad:
        return float("-inf")
    best, cut, lost, caught = 0.0, float("-inf"), 0, 0
    for r in found:
        lost, caught = lost + r["good"], caught + r["bad"]
        gain = caught / bad - lost / good
        if gain > best:
            edge = (r["c"] + 0.5) / 16
            best, cut = gain, float(np.sign(edge) * np.expm1(abs(edge)))
    return cut


def gumbel(doc_id: object) -> object:
    """Standard Gumbel noise from the hash of a column."""
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(8)), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def whole_keys(scored: DataFrame) -> tuple[DataFrame, list[str]]:
    """``scored`` with its key in whole numbers of 0 to 2**60, and what parts equal keys: a hash of the id, then the row's number.

    The scale is a power of two that the largest key sets, so no key is cut off and keys keep their order to 2**-59 of it.
    """
    most = scored.agg(F.max(F.abs("key")).alias("m")).first()["m"] or 1.0
    scale = 2.0 ** (58 - max(0, int(np.ceil(np.log2(max(most, 1.0))))))
    rank, tie, row = free_names(scored, "rank", "tie", "row")
    out = scored.withColumn(rank, (F.col("key") * scale).cast("long") + (1 << 59))
    return out.withColumn(tie, F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(9)), 4)).withColumnRenamed("__n", row), [rank, tie, row]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, doc_id, log_weight, key (log weight plus noise) and selected: whether the key is among the k largest, exactly k rows of them.

    k: how many documents to draw; if None, as many as have a log weight above the cut that the labels call for. Equal keys are parted
    by a hash of the doc_id, then row by row. A null or wordless text weighs 0; a null doc_id has the noise of the null value. Repeated rows have equal keys
    and are drawn one by one. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    rows = marked(docs, labels, keep)
    ratios = log_ratios(ngram_counts(rows))
    columns = ("doc_id", *keep, "quality")
    scored = with_log_weight(rows, ratios, columns)
    scored = materialise(scored.withColumn("key", F.col("log_weight") + gumbel("doc_id")).withColumn("__n", F.monotonically_increasing_id()), "weights")
    if k is None:
        k = scored.where(F.col("log_weight") > acceptance_cut(scored)).count()
    ranked, order = whole_keys(scored)
    edge = kth_largest(ranked.select(*order), order, k) if k > 0 else None
    selected = no_smaller(order, edge) if edge else F.lit(k > 0)
    return ranked.select(*keep, "doc_id", "log_weight", "key", selected.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the draw selects, with their columns; rows alike in doc_id and text stay if one of them is drawn.

    Null, empty and wordless texts weigh 0 and stay or go like others of that weight; a null doc_id takes part. An empty table gives no rows.
    """
    t, d, key = free_names(docs, "t", "d", "k")
    keyed = docs.withColumn(t, F.xxhash64(F.coalesce("text", F.lit(""))))
    chosen = resample(keyed, labels, k, keep=(t,)).where("selected").select(F.col("doc_id").alias(d), F.col(t).alias(key)).distinct()
    return keyed.join(chosen, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(t) == F.col(key)), "left_semi").drop(t)
