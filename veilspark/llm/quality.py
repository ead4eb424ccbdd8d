"""Quality by compression: the class whose dictionary compresses a text better is the likelier one.

One zstandard dictionary is trained from good and one from bad labelled texts. A text is compressed with both, in
blocks of `BLOCK` bytes so that a long text's own repetitions do not drown the dictionaries; the difference of the two
sizes over their sum goes through a logistic curve fitted on labelled texts that the dictionaries have not seen.

A null or empty text has a difference of 0, so its score follows from the shares of the labels alone. Rows that repeat a
doc_id are scored each, by their own text; long texts are whole. An empty table gives an empty one, and without labels
all scores are 0.5. Other columns are kept as they are, but those that bear the name of an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import slices, text_batches, without
from ._sample import labelled_sample

BLOCK = 2048


@dataclass
class Quality:
    good: bytes
    bad: bytes
    slope: float
    bias: float

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """(bad size - good size) / (bad size + good size): above 0 if the good dictionary fits better."""
        sizes = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=3)
            squeeze = zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False)
            sizes.append([sum(len(squeeze.compress(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)) for raw in ((t or "").encode() for t in texts)])
        good, bad = np.array(sizes, float)
        return (bad - good) / np.maximum(bad + good, 1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.differences(texts) + self.bias, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and bias by Newton's method, on x scaled to unit spread."""
    spread = x.std() or 1.0
    a, w = np.stack([x / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * len(x) * w * [1, 0])
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1])


def fit(sample: list[tuple[str, int]], size: int = 112_640) -> Quality:
    """The first half of each class makes its dictionary, the other half the curve."""
    classes = [[t for t, v in sample if t and int(v > 0) == c] for c in (0, 1)]
    share = (len(classes[1]) + 0.5) / (len(classes[0]) + len(classes[1]) + 1)

    def dictionary(texts: list[str]) -> bytes:
        blocks = [raw[i : i + BLOCK] for raw in (t.encode() for t in texts) for i in range(0, len(raw), BLOCK)]
        try:
            return zstandard.train_dictionary(size, blocks, level=3).as_bytes()
        except zstandard.ZstdError:  # too few texts to train from: the texts themselves
            return b" ".join(blocks)[:size] or b" " * 8

    half = [len(c) // 2 for c in classes]
    model = Quality(dictionary(classes[1][: half[1]]), dictionary(classes[0][: half[0]]), 0.0, float(np.log(share / (1 - share))))
    rest = [(t, c) for c in (0, 1) for t in classes[c][half[c] :]]
    if min(half) > 4:
        model.slope, model.bias = _logistic(model.differences([t for t, _ in rest]), np.array([float(c) for _, c in rest]))
    return model


def score(docs: DataFrame, model: Quality) -> DataFrame:
    """docs with score: the probability of label 1."""
    docs = without(docs, ["score"])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    names = docs.columns

    def run(batches):
        model = shared.value
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column("text").to_pylist()))], names=[*names, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return text_batches(docs).mapInArrow(run, schema + ", score double")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = 6000, most_bytes: int = 16_384) -> Quality:
    """From labels.quality of at most `sample` rows that `allowed` (over doc_id) lets in."""
    return fit(labelled_sample(docs, labels, "quality", allowed, sample, most_bytes))


def quality(docs: DataFrame, labels: DataFrame, allowed: Column, threshold: float = 0.3) -> DataFrame:
    """docs with score and predicted (1 if the score reaches the threshold)."""
    return score(docs, train(docs, labels, allowed)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
