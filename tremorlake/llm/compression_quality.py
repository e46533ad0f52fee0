"""Quality from compression: dictionaries of good and of bad text, and the difference they make.

Two zstandard dictionaries are trained on a bounded sample of labelled texts, one for each label. A text
is cut into segments of ``SEGMENT`` bytes (all of them, whatever its length), each compressed with either
dictionary; the difference of the two sums over their mean is the normalised difference, and the size
without a dictionary over the length says how repetitive the whole text is. A logistic calibration, fitted
on sample rows that no dictionary has seen and weighted to the labels' true shares, makes them a score.

Defined edge cases: a null or empty text gets the score of the training share of label 1; repeated rows
each give a row; without labelled rows of both classes every score is that share (0.5 without any).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import class_counts, crc_mod, fit_logistic, labelled_sample, map_texts, sigmoid, table

#: At most so many training texts of either label.
SAMPLE_PER_CLASS = 3000
SEGMENT = 4096
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
HELD = (3, 1)


class Compressors:
    def __init__(self, good: bytes, bad: bytes):
        import zstandard

        def of(data):
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO)) if data else zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)

        self.good, self.bad, self.plain = of(good), of(bad), of(b"")

    def features(self, text: str) -> tuple[float, float, float]:
        raw = text.encode()
        view = memoryview(raw)
        good = bad = 0
        for at in range(0, len(raw), SEGMENT):
            part = view[at : at + SEGMENT]
            good += len(self.good.compress(part))
            bad += len(self.bad.compress(part))
        plain = len(self.plain.compress(raw))
        return 2 * (bad - good) / (bad + good), plain / len(raw), np.log(len(raw))


def _dictionary(texts: list[str]) -> bytes:
    """Of segments of the texts; texts too few or too alike for training give the texts' own bytes as dictionary."""
    import zstandard

    parts = [raw[at : at + SEGMENT] for raw in (t.encode() for t in texts) for at in range(0, len(raw), SEGMENT)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICTIONARY_BYTES]


def fit(sample: list[tuple[str, int]], counts: tuple[int, int]) -> tuple[bytes, bytes, list[float] | None, float]:
    """Both dictionaries, the calibration's coefficients (None without both labels) and the share of label 1."""
    share = counts[1] / sum(counts) if sum(counts) else 0.5
    sample = [(t, y) for t, y in sample if t]
    train = [[t for i, (t, y) in enumerate(sample) if y == k and i % 2] for k in (0, 1)]
    held = [(t, y) for i, (t, y) in enumerate(sample) if not i % 2]
    if not (train[0] and train[1] and len({y for _, y in held}) == 2):
        return b"", b"", None, share
    good, bad = _dictionary(train[1]), _dictionary(train[0])
    c = Compressors(good, bad)
    x, y = _columns(np.array([c.features(t) for t, _ in held])), np.array([y for _, y in held], float)
    weights = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return good, bad, fit_logistic(x, y, 1e-5, weights).tolist(), share


def _columns(f: np.ndarray) -> np.ndarray:
    d, r, n = f[:, 0] * 10, f[:, 1] * 4, f[:, 2] / 8
    return np.column_stack([d, r, n, r * n, r * r, d * r])


def compression_scores(docs: DataFrame, labels: DataFrame, target: str = "quality", held: tuple[int, int] | None = HELD, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, score, size_difference, plain_ratio`` of every document."""
    good, bad, w, share = fit(labelled_sample(docs, labels, target, per_class, held), class_counts(labels, target, held))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad, w, share))  # two dictionaries of a fixed size

    def make():
        good, bad, w, share = shared.value
        c = Compressors(good, bad)
        w = None if w is None else np.array(w)

        def score(text):
            if not text or w is None:
                return share, 0.0, 0.0
            f = c.features(text)
            return float(sigmoid(_columns(np.array([f])) @ w[:-1] + w[-1])[0]), f[0], f[1]

        return score

    return map_texts(docs, make, "score double, size_difference double, plain_ratio double")


def op1_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = compression_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
