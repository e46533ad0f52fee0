"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded, documented sample of labelled rows. All their words are terms; document frequencies come
from all documents. A word's weight is (1 + log count) * idf, times 1 for words whose document
counts in the sample don't depend on the label and more for those that do (by standard errors, one text of each group of near copies counted). The
examples, ordered by their most similar pivot, lie in blocks of ``BLOCK``; each term keeps its largest weight per block. The lists of
frequent terms are stored as rows over all examples and added up first, by one matrix product for a group of texts. A query
bounds every block by its largest sum so far plus the weights of the other terms times their maxima and adds up the blocks by falling bound, ``FIRST`` of
them and then twice as many at a time, until no bound reaches the K-th best cosine so far, so the K nearest are exact; equal
cosines go to the smaller example number. Neighbours vote with weights that fall with their distance, beside a small prior vote of label 1's share, and
a logistic calibration, fitted on the examples with each left out of its own vote, makes the vote a score.

Defined edge cases: a text that is null, empty or without any word of an example has no neighbour and gets the sample's
smoothed share of label 1 among such texts; a null doc_id stays null; repeated rows each give a row and count as examples
once; a very long text is scored whole; other columns are ignored (or kept, by ``without_toxic``), whatever their names;
without labelled examples of both labels every score is the share of label 1 among the training labels (0 without any);
an empty table gives no rows.
"""

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, alnum_words, class_counts, crc_mod, document_frequencies, fit_logistic, labelled_rows, map_texts, mix, sigmoid, small_batches, table, window_hashes

#: At most so many examples of either label.
SAMPLE_PER_CLASS = 3000
#: Standard errors by which a word's shares under both labels may differ by chance.
CHANCE = 2.0
K, BLOCK, FIRST, PIVOTS = 15, 64, 8, 24
#: Terms that one in ``OFTEN`` examples has or more (``ROWS`` of them at most, the most frequent) are held as rows over all examples; texts meet
#: them in groups of ``TOGETHER``. Fewer than ``TOGETHER`` such terms stay in blocks, which can be skipped.
OFTEN, ROWS, TOGETHER = 16, 512, 64
PRIOR = 0.5
HELD = (4, 2)
THRESHOLD = 0.3


def sketch(words: list[bytes], hashed: WordHash) -> tuple[int, ...]:
    """The same for near copies: the smallest of a text's 5-word shingles under four hash functions."""
    h = window_hashes(hashed.of(words), 5)
    return tuple(int(mix(h + np.uint64(k)).min()) for k in range(4)) if len(h) else tuple(words)


def association(size: int, texts: list[np.ndarray], keys: list[tuple[int, ...]], labels: list[int]) -> np.ndarray:
    """For each term a factor of 1 or more: by how many standard errors its shares of the texts of either label differ, beyond chance."""
    counts, total, seen = np.zeros((2, size)), [0, 0], set()
    for terms, key, y in zip(texts, keys, labels):
        if len(terms) and key not in seen:
            seen.add(key)
            total[y] += 1
            counts[y, terms] += 1
    n0, n1 = total
    if not n0 or not n1:
        return np.ones(size)
    p = (counts.sum(0) + 1) / (n0 + n1 + 2)
    return np.maximum(1.0, np.abs(counts[1] / n1 - counts[0] / n0) / np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)) - CHANCE)


def numbered(rows: list) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]], list[tuple[int, ...]]]:
    """The words of all texts as numbers, each text's terms with their counts, and its ``sketch``; ``rows`` gives up its texts one by one."""
    number, texts, keys, hashed = {}, [], [], WordHash()
    for at, (i, text, y) in enumerate(rows):
        words = alnum_words(text)
        counts = Counter(words)
        texts.append((np.array([number.setdefault(w, len(number)) for w in counts], np.int32), np.array(list(counts.values()), np.int32)))
        keys.append(sketch(words, hashed))
        rows[at] = (i, None, y)
    return number, texts, keys


class Terms:
    """Words as numbers with their weights, and unit vectors of texts."""

    def __init__(self, words: list[bytes], weight: np.ndarray):
        self.number, self.weight = dict(zip(words, range(len(words)))), weight

    def vector(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, ascending, and weights."""
        counts = Counter(words)
        terms = np.fromiter(map(self.number.get, counts, repeat(-1)), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.float64, len(counts))
        known = terms >= 0
        terms, n = terms[known], n[known]
        return unit(terms, n, self.weight)


def unit(terms: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms)
    terms, w = terms[order], (1 + np.log(counts[order])) * weight[terms[order]]
    return terms, w / np.sqrt((w * w).sum()) if len(w) else w


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def by_similarity(size: int, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The examples' numbers, those with the same most similar pivot (of ``PIVOTS`` examples) together, the most similar first."""
    if not vectors:
        return np.empty(0, np.int64)
    chosen = np.unique(np.linspace(0, len(vectors) - 1, PIVOTS).astype(int))
    held = np.unique(np.concatenate([vectors[i][0] for i in chosen]))
    place = np.full(size, len(held), np.int32)  # terms that no pivot has share a row of zeros
    place[held] = np.arange(len(held))
    pivots = np.zeros((len(held) + 1, len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        pivots[place[vectors[i][0]], j] = vectors[i][1]
    cosine = np.array([w.astype(np.float32) @ pivots[place[t]] for t, w in vectors])
    return np.lexsort((-cosine.max(1), cosine.argmax(1)))


class BlockMaxIndex:
    """Postings by term and place, and for each term and block where its postings are and their largest weight.

    Places are the examples ordered by similarity, so that a block's examples share terms; ``number`` has their numbers.
    """

    def __init__(self, size: int, vectors: list[tuple[np.ndarray, np.ndarray]], labels: list[int]):
        self.number = by_similarity(size, vectors)
        self.place = np.argsort(self.number)
        self.labels = np.array(labels, float)
        self.blocks = -(-len(vectors) // BLOCK)
        vectors = [vectors[i] for i in self.number.tolist()]
        term = np.concatenate([np.empty(0, np.int64), *(t for t, _ in vectors)])
        example = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.empty(0), *(w for _, w in vectors)])
        lists = np.bincount(term, minlength=size)
        longest = np.argsort(-lists, kind="stable")[:ROWS]
        longest = longest[lists[longest] * OFTEN >= max(1, len(vectors))]
        longest = longest if len(longest) >= TOGETHER else longest[:0]
        self.row = np.full(size, -1, np.int32)
        self.row[longest] = np.arange(len(longest))
        whole = self.row[term] >= 0
        self.whole = self.row[term[whole]], example[whole], weight[whole]
        term, example, weight = term[~whole], example[~whole], weight[~whole]
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        block, term = self.example // BLOCK, term[order]
        new = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.block, self.start, self.count = block[new].astype(np.min_scalar_type(self.blocks)), new.astype(np.int32), np.diff(new, append=len(term))
        self.most = np.maximum.reduceat(self.weight, new) if len(new) else np.empty(0)
        self.of_term = np.searchsorted(term[new], np.arange(size + 1))
        #: postings (rows, always added up, have none) of all terms of the queries so far, and how many of them were added up
        self.met, self.read = 0, 0

    def rows(self) -> np.ndarray:
        """The longest lists as rows, made where they are used; they aren't part of what is sent."""
        if not hasattr(self, "_rows"):
            self._rows = np.zeros((int(self.row.max(initial=-1)) + 1, self.blocks * BLOCK))
            self._rows[self.whole[:2]] = self.whole[2]
        return self._rows

    def sent(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "_rows"}

    def all_nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> Iterator[list[tuple[int, float]]]:
        """For each query the K examples of the largest cosine above 0, as (number, cosine); ``without`` names an example that each leaves out."""
        for at in range(0, len(vectors), TOGETHER):
            group = vectors[at : at + TOGETHER]
            queries = np.zeros((len(group), len(self.rows())))
            for q, (terms, weights) in zip(queries, group):
                row = self.row[terms]
                q[row[row >= 0]] = weights[row >= 0]
            for i, (v, scores) in enumerate(zip(group, queries @ self.rows())):
                yield self._search(v, scores, without[at + i] if without else -1)

    def nearest(self, v: tuple[np.ndarray, np.ndarray], without: int = -1) -> list[tuple[int, float]]:
        return next(self.all_nearest([v], [without]))

    def _search(self, v: tuple[np.ndarray, np.ndarray], scores: np.ndarray, without: int) -> list[tuple[int, float]]:
        """``scores`` has what the longest lists add up to, and zeros behind the last example."""
        terms, weights = v
        if without >= 0:
            scores[self.place[without]] = 0
        sizes = self.of_term[terms + 1] - self.of_term[terms]
        entries = ranges(self.of_term[terms], sizes)
        w, block = np.repeat(weights, sizes), self.block[entries]
        bound = np.bincount(block, w * self.most[entries], self.blocks) + scores.reshape(-1, BLOCK).max(1)
        order = np.argsort(-bound, kind="stable")
        bound, rank = bound[order], np.empty(self.blocks, self.block.dtype)
        rank[order] = np.arange(self.blocks)
        turn_of = rank[block]
        by_turn = np.argsort(turn_of, kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(turn_of, minlength=self.blocks)))
        entries, w = entries[by_turn], w[by_turn]
        start, count = self.start[entries], self.count[entries]
        self.met += int(count.sum())
        done, turn = 0, FIRST
        while done < self.blocks:
            best = np.partition(scores, -K)[-K] if len(scores) >= K else 0.0
            upto = done + np.count_nonzero(bound[done : done + turn] >= max(best - 1e-9, 1e-300))
            if upto == done:
                break
            part = slice(edges[done], edges[upto])
            places = ranges(start[part], count[part])
            self.read += len(places)
            scores += np.bincount(self.example[places], np.repeat(w[part], count[part]) * self.weight[places], len(scores))
            if without >= 0:
                scores[self.place[without]] = 0
            done, turn = done + turn, 2 * turn
        scores = np.round(scores, 12)
        found = np.flatnonzero(scores > 0)
        if len(found) > K:
            found = found[scores[found] >= np.partition(scores[found], -K)[-K]]
        found = found[np.lexsort((self.number[found], -scores[found]))[:K]]
        return list(zip(self.number[found].tolist(), scores[found].tolist()))

    def votes(self, near: list[tuple[int, float]], share: float) -> tuple[float, float, float]:
        """Label 1's part of the neighbours' votes, the best cosine, and by how much label 1's best is better.

        A vote weighs cosine / (distance + 0.1); the overall share of label 1 has PRIOR votes, so hardly
        similar neighbours say little.
        """
        w = [s / (1.1 - s) for _, s in near]
        y = [self.labels[e] for e, _ in near]
        best = [max((s for (_, s), z in zip(near, y) if z == k), default=0.0) for k in (1, 0)]
        return (sum(a * b for a, b in zip(w, y)) + PRIOR * share) / (sum(w) + PRIOR), near[0][1], best[0] - best[1]


def fit(docs: DataFrame, labels: DataFrame, target: str, held, per_class: int):
    """Words, their weights, the index's arrays, the examples' ids, the calibration, the score of texts without a neighbour and label 1's share."""
    sample = labelled_rows(docs, labels, target, per_class, held)
    counts = class_counts(labels, target, held)
    y = np.array([y for *_, y in sample], float)
    if len({*y}) < 2:
        return [], np.empty(0), BlockMaxIndex(0, [], []).sent(), [], None, counts[1] / max(1, sum(counts)), 0.0
    number, texts, keys = numbered(sample)
    words = list(number)
    del number
    frequency, n = document_frequencies(docs, frozenset(words)), docs.count()
    weight = np.array([math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1 for w in words]) * association(len(words), [t for t, _ in texts], keys, y.astype(int).tolist())
    vectors = [unit(*t, weight) for t in texts]
    rows = np.where(y == 1, counts[1] / y.sum(), counts[0] / (1 - y).sum())  # what an example stands for
    share = counts[1] / sum(counts)
    index, x, kept = BlockMaxIndex(len(words), vectors, y.tolist()), [], []
    for e, near in enumerate(index.all_nearest(vectors, list(range(len(vectors))))):
        if near:
            x.append(index.votes(near, share))
            kept.append(e)
    none = np.ones(len(y), bool)
    none[kept] = False
    blank = float(((rows * y)[none].sum() + rows.mean() * share) / (rows[none].sum() + rows.mean()))
    w = fit_logistic(np.array(x), y[kept], 1e-4, rows[kept] / rows[kept].mean()).tolist() if len({*y[kept]}) == 2 else [0.0, 0.0, 0.0, math.log(share / (1 - share))]
    return words, weight, index.sent(), [i for i, *_ in sample], w, blank, share


def scorer(shared):
    """Scores and evidence of a batch's texts by the broadcast model, which is plain arrays and lists."""

    def make():
        words, weight, arrays, ids, w, blank, share = shared.value
        terms, index = Terms(words, weight), BlockMaxIndex.__new__(BlockMaxIndex)
        vars(index).update(arrays)

        def evidence(near):
            if not near:
                return blank, []
            p = float(sigmoid(sum(a * b for a, b in zip(w, index.votes(near, share))) + w[-1]))
            return p, [{"doc_id": ids[e], "cosine": s, "label": int(index.labels[e])} for e, s in near[:3]]

        def score(texts):
            for at in range(0, len(texts), TOGETHER):
                part = texts[at : at + TOGETHER]
                yield from map(evidence, index.all_nearest([terms.vector(alnum_words(t or "")) for t in part]) if w else [[]] * len(part))

        return score

    return make


def toxicity_scores(docs: DataFrame, labels: DataFrame, target: str = "toxic", held: tuple[int, int] | None = HELD, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """``doc_id, score, evidence``: the evidence is the nearest three examples with their cosines and labels."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, held, per_class))  # bounded by the sample
    return map_texts(docs, scorer(shared), "score double, evidence array<struct<doc_id:bigint,cosine:double,label:int>>", batches=True)


def without_toxic(docs: DataFrame, labels: DataFrame, target: str = "toxic", held: tuple[int, int] | None = HELD, per_class: int = SAMPLE_PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, with all their columns."""
    make = scorer(docs.sparkSession.sparkContext.broadcast(fit(docs, labels, target, held, per_class)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fn = make()
        for texts in batches:
            yield pd.Series([p for p, _ in fn(texts.to_list())], dtype="float64")

    return small_batches(docs).where(score("text") < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
