"""Quality scores from zstandard dictionaries of good and of bad text (operator 7).

Two dictionaries are built from a bounded sample of labelled texts, one for each label. A text
is compressed piece by piece with either; the difference of its two sizes, for each byte of
text, says which of them it is like. An isotonic curve fitted to other labelled texts of the
sample, with a little of a logistic one so that no two differences tie, turns that into a
probability of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import map_texts
from corvane.llm.training_rows import held_out, sample_texts

#: Of each label at most so many texts of at most so many bytes are learnt from.
SAMPLE, LONGEST = 1200, 1 << 16
#: Bytes of a dictionary, of a piece that is compressed by itself, and the level.
DICTIONARY, PIECE, LEVEL = 110 << 10, 1024, 3


#: The logistic curve's part of a score.
SMOOTH = 0.01


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing curve nearest to the labels: pooled neighbours, at their mean places."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        blocks.append([weight[i] * x[i], weight[i] * y[i], weight[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def cut(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


class CompressionClassifier:
    """Two dictionaries and a calibration; without texts of either label it says 0.5 to everything."""

    def __init__(self, labelled: Sequence[tuple[int, str]], rows: Sequence[int] = (1, 1)):
        """``rows``: how many labelled rows there are of either label; the sample's texts weigh accordingly."""
        self.dictionaries: list[bytes] = []
        self.slope, self.offset, self.curve = 0.0, 0.0, None
        by_label = [[t.encode() for y, t in labelled if y == label] for label in (0, 1)]
        if not all(by_label):
            return
        # every second text makes the dictionaries, the rest calibrates
        self.dictionaries = [self._dictionary(texts[::2]) for texts in by_label]
        rest = [texts[1::2] or texts for texts in by_label]
        x = np.array([self.measure(t) for texts in rest for t in texts])
        y = np.array([float(label) for label, texts in enumerate(rest) for _ in texts])
        share = [len(x) * n / (len(r) * sum(rows)) for x, n, r in zip((x, x), rows, rest, strict=True)]
        self._fit(x, y, np.array([share[int(v)] for v in y]))

    @staticmethod
    def _dictionary(texts: list[bytes]) -> bytes:
        samples = [p for t in texts for p in cut(t)]
        try:
            return zstandard.train_dictionary(min(DICTIONARY, max(512, sum(map(len, samples)) // 8)), samples).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
            return b"".join(samples)[-DICTIONARY:]

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        if not hasattr(self, "ready"):
            kinds = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            self.ready = [zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False) for d in kinds]
        return self.ready

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ready"}

    def measure(self, text: bytes) -> float:
        """(size with the bad dictionary - size with the good one) for each byte; 0 for no text."""
        if not text or not self.dictionaries:
            return 0.0
        bad, good = self._compressors()
        parts = cut(text)
        return (sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)) / len(text)

    def _fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Newton's method with a little ridge, so that separable samples have a finite slope."""
        scale = float(np.std(x)) or 1.0
        design = np.column_stack([x / scale, np.ones(len(x))])
        w = np.zeros(2)
        ridge = np.diag([1e-2, 1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient = design.T @ (weight * (p - y)) + ridge @ w
            step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, gradient)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.offset = float(w[0]) / scale, float(w[1])
        self.curve = isotonic(x, y, weight)

    def score(self, text: str) -> float:
        """The probability of label 1; for empty text that of the calibration at no difference."""
        x = self.measure(text.encode())
        smooth = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * x + self.offset))))
        return (1 - SMOOTH) * float(np.interp(x, *self.curve)) + SMOOTH * smooth if self.curve else smooth


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, longest: int = LONGEST) -> CompressionClassifier:
    """A classifier from a bounded sample of the labelled documents outside the held-out fold; labels that differ for one id count as the lower one."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).where(~held_out("__id"))
    rows = own.join(known, "__id")
    found = sample_texts(rows, "__label", sample, longest, "__id", "__text", own)
    totals = {r["__label"]: r["count"] for r in rows.groupBy("__label").count().collect()}
    return CompressionClassifier([(c, t) for c, _, t in found], [totals.get(0, 0), totals.get(1, 0)])


def score_quality(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per document: id, ``keep``, held_out, score (0 to 1) and predicted (1 from 0.5 on).

    Null counts as the empty text, which has the calibration's score at no difference. Repeated
    rows each get a row, an empty table an empty result. A null id isn't held out. A kept
    column that is called like a result gives way to it. No shuffle; the model is bounded.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> dict:
        return {"score": pa.array([shared.value.score(t) for t in texts.to_pylist()], pa.float64())}

    scored = map_texts(docs, work, "score double", id_col, text_col, [k for k in keep if k not in ("held_out", "predicted")])
    return scored.select(*[c for c in scored.columns if c != "score"], held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model of the labelled ones outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
