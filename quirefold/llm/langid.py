"""Language identification in two steps: first the family, by a linear SVM of each against the others, then one-versus-one linear SVMs between its languages.

Features are the counts of letter trigrams (bytes of the lower-cased text, all else as one space), hashed and scaled to
their share of the text. The models are fitted on a bounded, documented sample of the labelled rows; every text is scored whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import bound_batches, materialise

CELLS = 1 << 14
#: Rows for each language that the models are fitted on: at most this many, those with the smallest hash of their id.
SAMPLE_PER_LANGUAGE = 400
#: For each row of a family, so many rows of other families, at most, tell it from them.
OTHERS = 4

# Language families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr ug uz",
    "indo-aryan": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "sinitic": "zh",
    "japonic": "ja",
    "koreanic": "ko",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cells_of(text: str) -> np.ndarray:
    """Hashed trigrams of the text's bytes."""
    raw = np.frombuffer((" " + NOT_LETTERS.sub(" ", text.lower()) + " ").encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64)
    gram = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return (gram * np.uint32(2654435761) >> np.uint32(18)).astype(np.int64)


def features(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells that occur, and the roots of their counts scaled to length 1."""
    count = np.bincount(cells, minlength=CELLS)
    some = np.flatnonzero(count)
    x = np.sqrt(count[some].astype(np.float32))
    return some, x / max(float(np.linalg.norm(x)), 1e-9)


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights of the cells and, last, the offset by dual coordinate descent with the hinge loss; rows are (cells, values), y is +1 or -1."""
    rng, w, alpha = np.random.default_rng(0), np.zeros(CELLS + 1, dtype=np.float32), np.zeros(len(rows))
    rows = [(np.append(c, CELLS), np.append(v, np.float32(1))) for c, v in rows]
    square = np.array([float(v @ v) for _, v in rows])
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            cells, values = rows[i]
            grad = y[i] * float(values @ w[cells]) - 1
            new = min(max(alpha[i] - grad / square[i], 0.0), cost)
            if new != alpha[i]:
                w[cells] += np.float32((new - alpha[i]) * y[i]) * values
                alpha[i] = new
    return w


def sample_rows(train: DataFrame, per_language: int) -> DataFrame:
    """doc_id, text, lang of the rows to fit on: of each language those with the smallest hashes of their id.

    Rows without an id, a language or a letter take no part; repeated rows count once. Fewer rows than asked for
    come only where repeated rows make up more than half of a language.
    """
    known = train.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    names = known.groupBy("lang").count().orderBy("lang").collect()
    # A hash lies below twice the share that is asked for with about twice as many rows: only those are ranked, however common a language is.
    # One entry a language is all that the driver and the plan hold.
    share = F.create_map(*chain.from_iterable((F.lit(r["lang"]), F.lit(2.0 * per_language / r["count"])) for r in names)) if names else F.lit(None)
    at = F.xxhash64("doc_id").cast("double") / float(1 << 64) + 0.5
    near = known.where(at < share[F.col("lang")]) if names else known
    # The ids are ranked without their texts; the texts of those chosen are then found by a join.
    ranked = near.select("doc_id", "lang", F.xxhash64("text").alias("t")).distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "t")))
    chosen = ranked.where(F.col("r") <= per_language)
    ids = chosen.select(F.col("doc_id").alias("__d"), F.col("lang").alias("__l"), F.col("t").alias("__t"))
    # At most ``per_language`` ids a language.
    found = known.select("doc_id", "text", "lang").join(F.broadcast(ids), (F.col("doc_id") == F.col("__d")) & (F.col("lang") == F.col("__l")) & (F.xxhash64("text") == F.col("__t")), "left_semi")
    return found.dropDuplicates(["doc_id", "text", "lang"])


def sparse_rows(sample: DataFrame) -> DataFrame:
    """lang, family, h (a hash of the row), cells and values of the sampled texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(n, h, *features(cells_of(t))) for n, h, t in zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in found], pa.string()), pa.array([FAMILY_OF.get(r[0], r[0]) for r in found], pa.string()), pa.array([r[1] for r in found], pa.int64()),
                 pa.array([r[2] for r in found], pa.list_(pa.int32())), pa.array([r[3] for r in found], pa.list_(pa.float32()))],
                ["lang", "family", "h", "cells", "values"],
            )

    rows = sample.select("lang", F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.mapInArrow(count, "lang string, family string, h long, cells array<int>, values array<float>")


def fit(train: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, others: int = OTHERS) -> dict:
    """Models from rows of ``doc_id, text, lang``: each family against the others, and each pair of languages within a family.

    Fitted on at most ``per_language`` rows a language that have a letter; a family meets at most ``others`` times ``per_language`` rows of the other
    families, drawn by hash. Every labelled language is learned. Each model is fitted in a task of its own, from sparse rows; the driver sees the
    weights alone, one vector a family and one a pair of languages of the same family.
    """
    rows = materialise(sparse_rows(sample_rows(train, per_language)), "sample")
    seen = rows.groupBy("family", "lang").count().collect()
    languages: dict[str, list[str]] = {}
    for r in sorted(seen, key=lambda r: (r["family"], r["lang"])):
        languages.setdefault(r["family"], []).append(r["lang"])
    families, total = sorted(languages), sum(r["count"] for r in seen)
    model: dict = {"families": families, "languages": languages, "pairs": {f: list(combinations(own, 2)) for f, own in languages.items()}}
    if not families:
        return model
    # A row stands for its own family, and against those others whose draw it is in.
    own = {f: sum(r["count"] for r in seen if r["family"] == f) for f in families}
    drawn = [F.when((F.col("family") == f) | (F.pmod(F.xxhash64("h", F.lit(f)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, others * per_language / max(1, total - own[f])))), F.lit(f)) for f in families]
    between = rows.select(F.explode(F.array_compact(F.array(*drawn))).alias("a"), F.lit("").alias("b"), "family", "lang", "h", "cells", "values")
    between = between.withColumn("y", F.when(F.col("family") == F.col("a"), 1.0).otherwise(-1.0))
    pairs = [(a, b, n, y) for f in families for a, b in model["pairs"][f] for n, y in ((a, 1.0), (b, -1.0))]
    tasks = between.select("a", "b", "h", "cells", "values", "y")
    if pairs:
        sides = train.sparkSession.createDataFrame(pairs, "a string, b string, lang string, y double")
        tasks = tasks.unionByName(rows.join(F.broadcast(sides), "lang").select("a", "b", "h", "cells", "values", "y"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["h", "y"], kind="stable")
        w = linear_svm([(np.asarray(c), np.asarray(v, dtype=np.float32)) for c, v in zip(frame["cells"], frame["values"], strict=True)], frame["y"].to_numpy())
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "w": [w.tobytes()]})

    found = {(r["a"], r["b"]): np.frombuffer(r["w"], dtype=np.float32) for r in tasks.groupBy("a", "b").applyInPandas(one, "a string, b string, w binary").collect()}
    order = [(f, "") for f in families] + [p for f in families for p in model["pairs"][f]]
    model["weights"] = np.stack([found[k] for k in order], axis=1)  # cells x models, the offsets last
    model["at"] = {k: i for i, k in enumerate(order)}
    return model


def sure(margin: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(2 * margin, -30, 30))))


def vote(margins: np.ndarray, names: list[str], pairs: list[tuple[str, str]], at: dict) -> tuple[str, float]:
    """The name with the most votes, ties by summed margins then by name; and its least probability against another."""
    if len(names) == 1:
        return names[0], 1.0
    votes, margin, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), dict.fromkeys(names, 1.0)
    for a, b in pairs:
        m = float(margins[at[a, b]])
        votes[a if m >= 0 else b] += 1
        margin[a] += m
        margin[b] -= m
        least[a], least[b] = min(least[a], sure(m)), min(least[b], sure(-m))
    best = max(names, key=lambda n: (votes[n], margin[n], n))
    return best, least[best]


def predict(text: str | None, model: dict) -> tuple[str, float]:
    """The family whose model is surest, then the language of it that wins most of its pairs; and how sure both are, of 0 to 1."""
    if not has_letter(text) or not model["families"]:
        return "und", 0.0
    cells, values = features(cells_of(text))
    weights = model["weights"]
    margins = values @ weights[cells] + weights[-1]
    best = int(np.argmax(margins[: len(model["families"])]))
    family = model["families"][best]
    lang, p = vote(margins, model["languages"][family], model["pairs"][family], model["at"])
    return lang, p * (sure(float(margins[best])) if len(model["families"]) > 1 else 1.0)


def identify_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row.

    Rows whose CRC-32 of the doc_id as text leaves 2 when divided by 4 are held out (a null doc_id counts as the text
    ``""``); the models learn from the others that have a language, and predict from the text alone. A null text, one without a letter,
    or nothing to learn from give ``und`` with score 0. Repeated rows each come back.
    """
    bound_batches(docs.sparkSession)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    rows = docs.select("doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.where(~held), per_language))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [predict(t, model.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
