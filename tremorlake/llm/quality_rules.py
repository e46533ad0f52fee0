"""Quality rules: counts that reject a text outright, and a hashed n-gram model for the rest.

The model is a logistic regression on hashed word uni- and bigrams and character trigrams (shares of a text's
n-grams per bucket), trained on a bounded labelled sample, calibrated on sample rows it was not trained
on, and applied in Arrow batches; a text is kept when its probability of label 1 reaches ``KEEP_AT``.
A word bigram of one word twice has a bucket of its own, whatever the word.

Defined edge cases: a null or empty text has zero counts and fails the base rules; lines are compared
whole, blanks included; repeated rows each give a row; a null doc_id stays null; an empty table gives no
rows; very long texts are taken whole, a few to a batch; other columns, whatever their names, are not read;
without labelled rows of both classes the base rules decide alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import WordHash, class_counts, fit_logistic, labelled_sample, map_texts, mix, sigmoid, table, window_hashes

#: At most so many training texts of either label.
SAMPLE_PER_CLASS = 1500
#: Buckets of word n-grams and of character n-grams.
BUCKETS = 4096
KEEP_AT = 0.5
MIN_WORDS, REPEAT_WIDTH, REPEAT_PERCENT = 10, 5, 20
SYMBOLS = b"#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"


def base_counts(text: str, raw: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(text.count(c) for c in _BLANK)
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines, seen = 0, set()
    for line in text.split("\n"):
        if line.strip(_BLANK):
            if line in seen:
                lines += 1
            else:
                seen.add(line)
    k = window_hashes(h, REPEAT_WIDTH)
    repeated = 0
    if len(k):
        order = np.argsort(k, kind="stable")
        same = k[order[1:]] == k[order[:-1]]
        if same.any():
            marks = np.zeros(len(k), bool)
            marks[order[1:][same]] = marks[order[:-1][same]] = True
            cover = np.zeros(len(h) + 1, np.int32)
            cover[np.flatnonzero(marks)] += 1
            cover[np.flatnonzero(marks) + REPEAT_WIDTH] -= 1
            repeated = int((np.cumsum(cover) > 0).sum())
    return chars, symbols, lines, repeated


def buckets(text: str, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of word n-grams and of trigrams of code points."""
    word = (mix(h) % np.uint64(BUCKETS - 1)).astype(np.int64)
    if len(h) > 1:
        pair = (window_hashes(h, 2) % np.uint64(BUCKETS - 1)).astype(np.int64)
        pair[h[1:] == h[:-1]] = BUCKETS - 1
        word = np.concatenate([word, pair])
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    gram = ((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) * 2654435761 >> 8) % BUCKETS if len(c) > 2 else c[:0]
    return word, gram


def train(sample: list[tuple[str, int]], counts: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Weights of the word and character buckets and the intercept, calibration folded in; None without both labels."""
    sample = [(t, y) for t, y in sample if t.strip(_BLANK)]
    y = np.array([y for _, y in sample], float)
    fold = np.arange(len(sample)) % 3 == 0
    if len({*y[fold]}) < 2 or len({*y[~fold]}) < 2:
        return None
    x = np.zeros((len(sample), 2 * BUCKETS), np.float32)
    hashed = WordHash()
    for i, (t, _) in enumerate(sample):
        word, gram = buckets(t, hashed.of(t.encode().split()))
        x[i, :BUCKETS] = np.bincount(word, minlength=BUCKETS) / max(1, len(word))
        x[i, BUCKETS:] = np.bincount(gram, minlength=BUCKETS) / max(1, len(gram))
    x *= 100
    w, b, v = np.zeros(2 * BUCKETS, np.float32), 0.0, np.zeros(2 * BUCKETS, np.float32)
    xt, yt = x[~fold], y[~fold].astype(np.float32)
    rate = 1.0 / max(1e-6, float((xt * xt).sum(1).mean()) / 4)
    for _ in range(300):  # accelerated gradient steps over the whole sample
        p = sigmoid(xt @ w + b)
        v = 0.9 * v - rate * (xt.T @ (p - yt) / len(yt) + 1e-4 * w).astype(np.float32)
        w += v
        b -= rate * float((p - yt).mean())
    z = x[fold] @ w + b
    share = counts[1] / max(1, sum(counts))
    weight = np.where(y[fold] == 1, share / y[fold].mean(), (1 - share) / (1 - y[fold].mean()))
    a, c = fit_logistic(z[:, None].astype(float), y[fold], 1e-4, weight)
    return w[:BUCKETS] * (100 * a), w[BUCKETS:] * (100 * a), float(b * a + c)


def quality_rules(docs: DataFrame, labels: DataFrame, held: tuple[int, int] | None = None, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Counts, verdicts and the model's probability (null where there is no model or no word) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled_sample(docs, labels, "quality", per_class, held), class_counts(labels, "quality", held)))

    def make():
        fitted, hashed = model.value, WordHash()

        def rules(text):
            raw = text.encode()
            words = raw.split()
            h = hashed.of(words)
            chars, symbols, lines, repeated = base_counts(text, raw, words, h)
            failed = len(words) < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * len(words)
            p = None
            if fitted and words:
                word, gram = buckets(text, h)
                p = float(sigmoid(fitted[0][word].sum() / len(word) + fitted[1][gram].sum() / max(1, len(gram)) + fitted[2]))
            return len(words), chars, symbols, lines, repeated, failed, not failed and (p is None or p >= KEEP_AT), p

        return rules

    return map_texts(docs, make, "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, probability double")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
