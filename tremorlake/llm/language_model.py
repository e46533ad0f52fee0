"""Language-model scores from a weighted backoff automaton over word n-grams of the whole corpus.

Every word, word pair and word triple of the training documents is counted, none is left out. The automaton's
states are the contexts (one or two words) that occur twice or more, the start of a document among them, and the root.
A state's arc for a word w has the probability ((c - 1) * c(context, w) / c + k * below(w)) / (c - 1 + k),
c being the context's count, k the ``KAPPA`` of its length, and ``below`` the next shorter context's probability; it leads to the
longest state that ends the context and w. A state's failure arc leads to its shorter context at the weight k / (c - 1 + k) and reads nothing.
A context that occurs once is no state: all that it would predict is the text that it was counted in. The root has
the unigrams, additively smoothed over all words, and an arc for every word. So all probabilities of a state add up to one.

The automaton is never in one place: its counts lie in buckets by the hash of their n-gram. Blocks of documents
send each distinct word, pair and triple once, with its count in the block's training documents; a bucket adds the counts
up and answers every request; a block then builds the part of the automaton that its own texts can reach (``Automaton``), and
walks it from left to right: a walk carries its state from word to word, takes failure arcs until an arc reads the word, and
adds up the logarithms. All texts of a block are walked at once; a long text is walked in stretches of ``STRETCH`` words, each from
two words earlier at the root, after which the state is that of the whole walk, as a state holds two words at most. A hot n-gram is one
request per block. Words travel as they are; pairs and triples as 64-bit hashes, of which ``VALUE_BITS`` stay beside
the bucket's number (an n-gram of a bucket's million is taken for another with a chance of one in a million while a bucket keeps its size,
up to ``1 << 63 - VALUE_BITS`` buckets, or 32 TB of text).

Defined edge cases: a null or empty text is one end token; a null doc_id stays null and is in the training set as the
contract's hash of an empty text says; repeated rows each give a row and each count; a very long text is a block of its
own; other columns are ignored, whatever their names; without training documents every count is 0 and the smoothed
unigrams decide (N = V = 0); an empty table gives no rows.
"""

from __future__ import annotations

from itertools import chain, count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import answered, assembled, bucket_count, bundle, cells, nullable, numbers, unbundle
from .common import crc_mod, fresh, mix, small_batches, table

#: The weight of what lies below contexts of one word and of two, in occurrences (held-out texts and texts that occur twice decided).
KAPPA = (300.0, 3.0)
HELD = (5, 1)
END, START = b"", b" "
VALUE_BITS = 40
#: Words of a long text that are walked in one go.
STRETCH = 512
_FLUSH = 400_000
#: Joins the words of a request; no UTF-8 text has this byte.
_BREAK = b"\xff"


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def training_size(training: DataFrame) -> tuple[int, int]:
    """N and V: all and distinct training tokens; counts are aggregated in the tasks before the shuffle."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
        yield out()

    words = small_batches(training).select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple(words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first())


class Grams:
    """The pairs and triples of a block's tokens, by where they end, and their places in the buckets' order."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, start: int, buckets: int):
        h = hashes[words]
        first = words == start
        #: places of the second word of each pair and of the third word of each triple
        self.pair_at = np.flatnonzero(~first)
        self.triple_at = self.pair_at[~first[self.pair_at - 1]]
        pair = np.zeros(len(h), np.uint64)
        pair[1:] = mix(mix(h[:-1]) + h[1:])
        triple = mix(pair[self.triple_at - 1] + h[self.triple_at])
        low = np.uint64(VALUE_BITS)
        self.pairs, self.triples = ((mix(g) % np.uint64(buckets)) << low | g & ((np.uint64(1) << low) - np.uint64(1)) for g in (pair[self.pair_at], triple))


def summed(keys: np.ndarray, ones: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The distinct keys by bucket: their values, and the sums of their ones."""
    keys = np.sort(keys << np.uint64(1) | ones.astype(np.uint64))  # at most 64 bits, as buckets are bounded
    at = np.flatnonzero(np.diff(keys >> np.uint64(1), prepend=~np.uint64(0)))
    if not len(at):
        return {}
    n = np.add.reduceat(keys & np.uint64(1), at)
    keys = keys[at] >> np.uint64(1)
    bucket = (keys >> np.uint64(VALUE_BITS)).astype(np.int64)
    value = keys & np.uint64((1 << VALUE_BITS) - 1)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return dict(zip(bucket[edges].tolist(), zip(np.split(value, edges[1:]), np.split(n, edges[1:]))))


def totals(values: list[np.ndarray], counts: list[np.ndarray]) -> list[np.ndarray]:
    """For each array of values, the sums of all counts of the equal ones."""
    value, n = np.concatenate(values), np.concatenate(counts)
    if not len(value):
        return values
    order = np.argsort(value)
    new = np.diff(value[order], prepend=~value[order[:1]]) != 0
    out = np.empty(len(n), np.uint64)
    out[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.split(out, np.cumsum([len(v) for v in values])[:-1])


class Automaton:
    """The states and arcs that the texts of a block can reach.

    State 0 is the root, state 1 + w the context of the word w, and the states after them are the block's distinct pairs; contexts that
    occur once have a number but are never reached. ``arcs`` holds state * words + word in ascending order, ``score`` and ``target`` what
    such an arc costs and where it leads; ``failure`` and ``weight`` are the same for the failure arc of each state.
    """

    def __init__(self, c1: np.ndarray, words: np.ndarray, grams: Grams, c2: np.ndarray, c3: np.ndarray, below: float, kappa: tuple[float, float] = KAPPA):
        """c1 are the counts of the words, c2 and c3 those of the distinct pairs and triples in the order of their keys."""
        n = self.words = len(c1)
        _, at, pair = np.unique(grams.pairs, return_index=True, return_inverse=True)
        first, second = words[grams.pair_at[at] - 1].astype(np.int64), words[grams.pair_at[at]].astype(np.int64)
        at = np.unique(grams.triples, return_index=True)[1]
        number = np.zeros(len(words), np.int64)
        number[grams.pair_at] = pair
        context, last = number[grams.triple_at[at] - 1], number[grams.triple_at[at]]  # a triple's two pairs
        p1 = (c1 + 0.5) / below
        p2 = interpolated(c1[first], c2, p1[second], kappa[0])
        p3 = interpolated(c2[context], c3, p2[last], kappa[1])
        of_word = np.where(c1 >= 2, np.arange(1, n + 1), 0)
        of_pair = np.where(c2 >= 2, np.arange(n + 1, n + 1 + len(c2)), of_word[second])
        two, three = np.flatnonzero((c1[first] >= 2) & (c2 > 0)), np.flatnonzero((c2[context] >= 2) & (c3 > 0))
        arcs = np.concatenate([np.arange(n), (first[two] + 1) * n + second[two], (context[three] + n + 1) * n + second[last[three]]])
        order = np.argsort(arcs)
        self.arcs = arcs[order]
        self.score = np.log10(np.concatenate([p1, p2[two], p3[three]]))[order]
        self.target = np.concatenate([of_word, of_pair[two], of_pair[last[three]]])[order]
        self.failure = np.concatenate([np.zeros(n + 1, np.int64), second + 1])
        self.weight = np.log10(np.concatenate([[1.0], kappa[0] / (np.maximum(c1 - 1, 0) + kappa[0]), kappa[1] / (np.maximum(c2 - 1, 0) + kappa[1])]))

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word each, and the log10 probabilities of the words."""
        state, cost, arc = state.copy(), np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.words + word[todo]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            arc[todo] = at
            todo = todo[self.arcs[at] != key]
            cost[todo] += self.weight[state[todo]]
            state[todo] = self.failure[state[todo]]
        return self.target[arc], cost + self.score[arc]

    def walk(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """log10 of the probability at each place of texts that lie one after another (0 where a text starts)."""
        out = np.zeros(len(words))
        ends = np.cumsum(sizes)
        pieces = -(-(sizes - 1) // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        start = (ends - sizes)[text]
        begin = start + 1 + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        at, end = np.maximum(start, begin - 2), np.minimum(begin + STRETCH, ends[text])
        order = np.argsort(at - end, kind="stable")  # the longest first, so those that have ended are at the end
        at, begin, end = at[order], begin[order], end[order]
        state = np.zeros(len(at), np.int64)
        while len(at):
            state, p = self.step(state, words[at])
            mine = at >= begin
            out[at[mine]] = p[mine]
            at = at + 1
            going = np.count_nonzero(at < end)
            at, begin, end, state = at[:going], begin[:going], end[:going], state[:going]
        return out


def interpolated(context: np.ndarray, together: np.ndarray, below: np.ndarray, kappa: float) -> np.ndarray:
    """Probabilities of words after contexts, from the counts of both and the shorter contexts' probabilities."""
    weight = np.maximum(context - 1, 0.0)
    return (weight * together / np.maximum(context, 1) + kappa * below) / (weight + kappa)


def language_model_scores(docs: DataFrame, held: Column, kappa: tuple[float, float] = KAPPA) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every document by a model of those that aren't held out."""
    import xxhash

    total, vocabulary = training_size(docs.where(~held))
    below = total + 0.5 * (vocabulary + 1)
    buckets = min(bucket_count(docs), 1 << 63 - VALUE_BITS)
    flag = fresh(docs, "_held")[0]

    def word_hashes(words):
        return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))

    def cut(ids, texts, held):
        rows = [[START, *tokens(t)] for t in texts]
        sizes = np.array([len(r) for r in rows], np.int64)
        number = dict.fromkeys(chain.from_iterable(rows))
        words, h = list(number), word_hashes(number)
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        words, h, bucket = [words[i] for i in order.tolist()], h[order], bucket[order]
        number.update(zip(words, count()))
        places = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.uint32, sizes.sum())
        trained = np.repeat(~np.array(held, bool), sizes)
        known = np.bincount(places, trained, len(words)).astype(np.uint64)
        grams = Grams(h, places, number[START], buckets)
        pairs, triples = summed(grams.pairs, trained[grams.pair_at]), summed(grams.triples, trained[grams.triple_at])
        edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        spans = dict(zip(bucket[edges].tolist(), zip(edges, [*edges[1:], len(words)])))
        none = np.empty(0, np.uint64)
        asked = {}
        for b in sorted({*spans, *pairs, *triples}):
            (lo, hi), (v2, n2), (v3, n3) = spans.get(b, (0, 0)), pairs.get(b, (none, none)), triples.get(b, (none, none))
            asked[b] = bundle(np.frombuffer(_BREAK.join(words[lo:hi]), np.uint8), known[lo:hi], np.diff(v2, prepend=np.uint64(0)), n2, np.diff(v3, prepend=np.uint64(0)), n3)
        return bundle(*numbers(ids), sizes, np.array([number[START]]), places, np.frombuffer(_BREAK.join(words), np.uint8)), asked

    def answer(requests):
        import pyarrow as pa

        texts, n1, d2, n2, d3, n3 = zip(*map(unbundle, requests))
        words = [t.tobytes().split(_BREAK) if len(n) else [] for t, n in zip(texts, n1)]
        at = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode().indices.to_numpy()
        sums = np.bincount(at, np.concatenate(n1)).astype(np.uint64)
        c1 = np.split(sums[at], np.cumsum([len(n) for n in n1])[:-1])
        c2, c3 = (totals([np.cumsum(d, dtype=np.uint64) for d in ds], ns) for ds, ns in ((d2, n2), (d3, n3)))
        return [bundle(*x) for x in zip(c1, c2, c3)]

    def assemble(kept, answers):
        import pyarrow as pa

        doc, null, sizes, start, places, raw = unbundle(kept)
        c1, c2, c3 = (np.concatenate(x).astype(float) for x in zip(*(unbundle(answers[b]) for b in sorted(answers))))
        grams = Grams(word_hashes(raw.tobytes().split(_BREAK)), places, int(start[0]), buckets)
        # answers come by bucket and value, as sorted keys do
        p = Automaton(c1, places, grams, c2, c3, below, kappa).walk(places, sizes)
        base, known = np.log10((c1[places] + 0.5) / below), c1[places] > 0
        at = np.cumsum(sizes) - sizes
        base[at], known[at] = 0, False
        sums = [np.add.reduceat(x, at) for x in (known.astype(np.int64), base, p)]
        return pa.table({"doc_id": nullable(doc, null), "n_tokens": sizes - 1, "n_known": sums[0], "base_score": sums[1], "score": sums[2]})

    blocks = cells(docs.withColumn(flag, held), cut, flag)
    scored = assembled(blocks, answered(blocks, answer), assemble, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model_scores(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), HELD[0]) == HELD[1])
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), HELD[0]) == HELD[1]).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
