"""Per-text operators against brute force: quality, license, toxicity, language model, tokenization."""

import base64
import hashlib
import math
import os
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest

from tremorlake.llm import blocks, bpe, common, compression_quality, language_model, license_scan, quality_rules, toxicity
from tremorlake.llm.common import alnum_words

P = pytest.importorskip("public_tokenizers")
EDGES = [None, "", " \n\t ", "x", "a" * 30000, "Ünïcode  two  spaces\n\nand\ttabs ", "same line\nsame line\n\n \nsame line", "the end.\x1c　x it's we'll 12345 $%& 'S"]


def docs(spark, texts, **extra):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in ({"lang": "xx", "source": "s", "n_chars": 0, "score": 1.0, "block": 2, "mark": "m", "row": 3, "_text": "t", "_y": 9} | extra).items()})


def corpus(n=120, seed=0, bad="junk!! buy now!! "):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" + "aeiou"[i % 5] * (i % 4) for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(20, 80))) for _ in range(n)]
    labels = (rng.random(n) < 0.4).astype(int)
    return [t if y else bad * 8 + t[:40].upper() for t, y in zip(texts, labels)], labels


def label_table(spark, y, column):
    return spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)] + [(None, 1), (5000, 1)], f"doc_id bigint, {column} int")


def test_bpe_equals_the_library(spark):
    import tiktoken

    with open(P.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = EDGES + corpus(40)[0] + ["naïve café 你好 🙂🙃 " * 50] + ["x"]
    got = {r["doc_id"]: r for r in bpe.digests(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    twice = docs(spark, ["a thonatat b", "a thonatat b"])
    assert bpe.digests(twice.unionByName(twice)).count() == 4
    assert bpe.digests(docs(spark, [])).count() == 0


def brute_rules(text):
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_quality_rules(spark):
    texts, y = corpus(200)
    texts = EDGES + texts + ["one two three four five six " * 20]
    df = docs(spark, texts)
    labels = label_table(spark, np.r_[np.zeros(len(EDGES)), y], "quality")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df, labels).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_rules(t), i
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    ok = [got[i + len(EDGES)]["probability"] >= 0.5 for i in range(200)]
    assert np.mean(np.array(ok) == (y == 1)) > 0.95
    assert quality_rules.quality_rules(docs(spark, []), label_table(spark, [], "quality")).count() == 0


def test_compression_scores(spark):
    texts, y = corpus(300, 1)
    got = {r["doc_id"]: r["score"] for r in compression_quality.compression_scores(docs(spark, texts + EDGES), label_table(spark, y, "quality")).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (y[i] == 1) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[300] == got[301]
    none = compression_quality.compression_scores(docs(spark, texts[:3]), label_table(spark, [], "quality")).collect()
    assert {r["score"] for r in none} <= {0.5, 1.0}  # no text is labelled, so the labels' share decides


def brute_licenses(text, threshold=license_scan.THRESHOLD):
    words, found = alnum_words(text or ""), {}
    for at in range(max(1, len(words) - license_scan.BLOCK_WORDS + 1)):
        block = set(words[at : at + license_scan.BLOCK_WORDS])
        for label, template in license_scan.TEMPLATES:
            t = set(alnum_words(template))
            if len(t & block) >= threshold * len(t) - 1e-9:
                found[label] = max(found.get(label, 0), len(t & block) / len(t))
    places, base = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.encode().split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(found))), 1.0 if base else max(found.values(), default=0.0)


def test_license_scan(spark):
    long = " ".join(f"v{i}" for i in range(70))
    texts = EDGES + [
        "Released under the MIT License.\nbody", "under the MIT\nlicense and under THE mit license", "Licensed under CC BY-NC 4.0", "Licensed under CC BY 4.0",
        f"{long} This work is licensed under the GNU General Public License, version 3. {long}", "cc by nc cc by nc", "the license of the software may be public", "Licensed under the Apache License, Version 2.0",
        license_scan.TEMPLATES[1][1].replace("charge", "cost"), "under the mit licenseé",
    ]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == brute_licenses(t), t
    assert got[len(EDGES) + 4]["labels"] == "gpl-3" and got[len(EDGES) + 3]["labels"] == ""
    assert license_scan.license_scan(docs(spark, [])).count() == 0


def test_wrapped_notices(spark):
    """Notices wrapped at 40 columns, anywhere in a long text."""
    texts, want = [], []
    for n, (label, template) in enumerate(license_scan.TEMPLATES):
        texts.append("\n".join(textwrap.wrap(" ".join(f"w{i}" for i in range(17 * n)) + " " + template + " " + "tail " * 90, 40)))
        want.append(label)
    # spread over many words, at every place of a long text
    for n, (label, template) in enumerate(license_scan.TEMPLATES * 2):
        w = template.split()
        gaps = (60 - len(w)) // max(1, len(set(w)))
        texts.append(" ".join([f"w{i}" for i in range(7 * n)] + [x for k in w for x in [k] + ["gap"] * (gaps if n % 2 else 0)] + ["tail"] * (90 - n)))
        want.append(label)
    got = license_scan.license_scan(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["labels"], r["score"]) for r in got] == [(brute_licenses(t)[5], brute_licenses(t)[6]) for t in texts]
    assert all(label in r["labels"].split(",") and r["score"] == 1.0 for label, r in zip(want, got))


def test_long_templates_and_close_notices(spark):
    """A template of more words than a block finds its own verbatim text; notices side by side are told one by one."""
    from pyspark.sql import functions as F

    license_text = " ".join(f"term{i}" for i in range(80))
    gpl, mit = license_scan.TEMPLATES[6], license_scan.TEMPLATES[1]
    texts = [f"{'before ' * 30}{license_text} after", license_text, license_text[: len(license_text) // 2]]
    got = [r["blocks"] for r in license_scan.license_scan(docs(spark, texts), [("own", license_text)]).orderBy("doc_id").collect()]
    assert [[(b["label"], b["first_word"], b["containment"]) for b in bs] for bs in got] == [[("own", 30, 1.0)], [("own", 0, 1.0)], []]
    size, wide = len(alnum_words(gpl[1])), len(alnum_words(mit[1]))
    texts = [" ".join([gpl[1]] * 3), " ".join([mit[1]] * 4), f"{gpl[1]} and {mit[1]} x {gpl[1]}"]
    got = license_scan.license_scan(docs(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") < 2, F.col("doc_id"))), [gpl, mit]).collect()
    assert {r["doc_id"] for r in got} == {0, 1, None}
    places = {r["doc_id"]: sorted((b["label"], b["first_word"]) for b in r["blocks"] if b["containment"] == 1) for r in got}
    assert places == {
        0: [("gpl-3", size * i) for i in range(3)],
        1: [("mit", wide * i) for i in range(4)],
        None: [("gpl-3", 0), ("gpl-3", size + wide + 2), ("mit", size + 1)],
    }


def test_notices_keep_the_fullest_block():
    rng = np.random.default_rng(8)
    for _ in range(300):
        ranks = [int(r) if r < 6 else None for r in rng.integers(0, 14, 60)]
        width, need = int(rng.integers(4, 14)), int(rng.integers(2, 6))
        best = max(len({r for r in ranks[i : i + width] if r is not None}) for i in range(len(ranks)))
        got = license_scan.notices([i for i, r in enumerate(ranks) if r is not None], ranks, width, need)
        assert max((n for n, _ in got), default=0) == (best if best >= need else 0)
        assert all(len({r for r in ranks[at : at + width] if r is not None}) >= n >= need for n, at in got)
        assert [at for _, at in got] == sorted({at for _, at in got})


def test_labelled_rows_pass_over_texts_beyond_the_bound(spark, monkeypatch):
    """Long texts, the first by hash among them, don't hide those after them; the bound holds for either label."""
    texts = [("long " * 400 if i % 5 == 0 else f"short text {i}") for i in range(60)]
    y = [i % 2 for i in range(60)]
    df, labels = docs(spark, texts), label_table(spark, y, "toxic")
    monkeypatch.setattr(common, "SAMPLE_BYTES", 1500)
    got = common.labelled_rows(df.unionByName(df.where("doc_id = 7")), labels, "toxic", 100, None)
    assert [(i, t, k) for i, t, k in got] == [(i, texts[i], y[i]) for i in range(60) if i % 5]
    monkeypatch.setattr(common, "SAMPLE_BYTES", 100)
    for k in (0, 1):
        assert 80 < sum(len(t) for _, t, z in common.labelled_rows(df, labels, "toxic", 100, None) if z == k) <= 100
    assert len(common.labelled_rows(df, labels, "toxic", 3, None)) == 6 - sum(i % 5 == 0 for i in first_by_hash(spark, labels, 3))
    assert common.labelled_rows(docs(spark, []), labels, "toxic", 100, None) == []


def test_blocks_of_similar_examples_are_skipped():
    """Examples of several groups, dealt in turn: their order by similarity makes blocks of one group, and a query leaves the others out."""
    rng = np.random.default_rng(5)
    vectors = []
    for i in range(1600):
        t = np.unique(np.r_[rng.choice(30, 6) + 30 * (i % 8), 240])  # one term that all share
        w = np.where(t == 240, 0.1, rng.random(len(t)) + 0.2)
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(241, vectors, [i % 2 for i in range(1600)])
    dense = np.zeros((1600, 241))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(0, 1600, 40):
        cosine = np.round(dense @ dense[q], 12)
        cosine[q] = 0
        near = index.nearest(vectors[q], without=q)
        assert [s for _, s in near] == pytest.approx(np.sort(cosine)[::-1][: toxicity.K])
        assert all(abs(cosine[e] - s) < 1e-9 for e, s in near)
    assert sorted(index.number.tolist()) == list(range(1600))
    assert 0 < index.read < 0.5 * index.met


def first_by_hash(spark, labels, n):
    from pyspark.sql import functions as F

    rows = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    return [r["doc_id"] for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()]


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(700):
        t = np.sort(rng.choice(40, 3, replace=False))
        w = rng.random(3).round(1) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(40, vectors, [i % 2 for i in range(700)])
    dense = np.zeros((700, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for q in range(60):
        cosines = np.round(dense @ dense[q], 12)
        want = sorted((-s, i) for i, s in enumerate(cosines) if s > 0 and i != q - 5)[: toxicity.K]
        got = index.nearest(vectors[q], without=q - 5 if q >= 5 else -1)
        assert [(i, round(s, 9)) for i, s in got] == [(i, round(-s, 9)) for s, i in want]


def test_toxicity(spark):
    texts, _ = corpus(400, 3, bad="")
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.3).astype(int)
    texts = [t + (" you nastyword" + "abc"[i % 3] + " end" if v else " fine end") for i, (t, v) in enumerate(zip(texts, y))]
    everything = texts + EDGES
    got = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs(spark, everything), label_table(spark, y, "toxic")).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got[i]["score"] >= 0.3) == (y[i] == 1) for i in held]) > 0.97
    assert got[400]["score"] == got[401]["score"] < 0.3 and got[400]["evidence"] == []
    # the evidence is that of a search through all examples by all their words
    words = {i: alnum_words(t or "") for i, t in enumerate(everything)}
    examples = [i for i in range(400) if i not in held]
    df, n = Counter(w for x in words.values() for w in set(x)), len(everything)
    # these texts have no near copies, so each counts for the words' shares
    total = Counter(int(y[i]) for i in examples)
    seen = [Counter(w for i in examples if y[i] == k for w in set(words[i])) for k in (0, 1)]
    factor = {}
    for w in {*seen[0], *seen[1]}:
        p = (seen[0][w] + seen[1][w] + 1) / (len(examples) + 2)
        error = math.sqrt(p * (1 - p) * (1 / total[0] + 1 / total[1]))
        factor[w] = max(1.0, abs(seen[1][w] / total[1] - seen[0][w] / total[0]) / error - toxicity.CHANCE)
    assert min(factor.values()) == 1 and factor[b"nastyworda"] > 2

    def vector(i):
        v = {w: (1 + math.log(c)) * (math.log((n + 1) / (df[w] + 1)) + 1) * factor[w] for w, c in Counter(words[i]).items() if w in factor}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()} if norm else {}

    vectors = {e: vector(e) for e in examples}
    for i in [*held[:20], *range(400, len(everything))]:
        q = vector(i)
        best = sorted(((-round(sum(x * vectors[e].get(w, 0) for w, x in q.items()), 9), e) for e in examples))[:3]
        assert [(r["doc_id"], round(r["cosine"], 9), r["label"]) for r in got[i]["evidence"]] == [(e, -s, y[e]) for s, e in best if s < 0]
    kept = toxicity.without_toxic(docs(spark, everything), label_table(spark, y, "toxic"))
    assert set(kept.columns) == set(docs(spark, []).columns)
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i in range(len(everything)) if got[i]["score"] < 0.3}


def test_toxicity_with_few_labels(spark):
    scores = lambda texts, y: [r["score"] for r in toxicity.toxicity_scores(docs(spark, texts), label_table(spark, y, "toxic"), held=None).orderBy("doc_id").collect()]
    assert scores(["a b", "c"], []) == [1.0, 1.0]  # the only label, of an id that has no text, is 1
    assert toxicity.toxicity_scores(docs(spark, []), label_table(spark, [0, 1], "toxic")).count() == 0
    # no word depends on the label significantly, the cosine still tells texts apart; repeated rows are one example each
    rng = np.random.default_rng(7)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 30, 12)) + (f" bad{i % 9}" if i % 2 else "") for i in range(60)]
    got = scores([*texts, *texts[:3]], [i % 2 for i in range(60)])
    assert len(got) == 63 and len({round(x, 6) for x in got}) > 10 and got[60] == got[0]
    twice = docs(spark, texts).unionByName(docs(spark, texts))
    assert toxicity.toxicity_scores(twice, label_table(spark, [i % 2 for i in range(60)], "toxic"), held=None).count() == 120


class BruteModel:
    """Word, pair and triple counts in dictionaries, and the backoff recursion as the docstring states it."""

    def __init__(self, texts):
        self.c = Counter()
        for t in texts:
            w = [language_model.START, *language_model.tokens(t)]
            for n in (1, 2, 3):
                self.c.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        self.words = {g[0]: c for g, c in self.c.items() if len(g) == 1 and g[0] != language_model.START}
        self.n, self.below = sum(self.words.values()), sum(self.words.values()) + 0.5 * (len(self.words) + 1)

    def p(self, context, w):
        if not context:
            return (self.words.get(w, 0) + 0.5) / self.below
        c, k = self.c[context], language_model.KAPPA[len(context) - 1]
        lower = self.p(context[1:], w)
        return lower if c < 2 else ((c - 1) * self.c[(*context, w)] / c + k * lower) / (c - 1 + k)

    def score(self, text):
        w = [language_model.START, *language_model.tokens(text)]
        return sum(math.log10(self.p(tuple(w[max(0, i - 2) : i]), w[i])) for i in range(1, len(w)))


def test_language_model(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    base = ["the cat sat on the mat", "a dog ran in the park", "The Cat ran"]
    texts = EDGES + [" ".join(rng.choice(base, 4)) + f" rare{i}" for i in range(60)]
    texts += [" ".join(f"v{x}" for x in rng.integers(0, 400, 80)) for _ in range(20)]
    texts.append(texts[-1])  # occurs twice
    df, held = docs(spark, texts), F.col("doc_id") % 5 == 1
    model = BruteModel([t for i, t in enumerate(texts) if i % 5 != 1])
    got = {r["doc_id"]: r for r in language_model.language_model_scores(df, held).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        w = language_model.tokens(t)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(x in model.words for x in w), model.n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10(model.p((), x)) for x in w))
        assert got[i]["score"] == pytest.approx(model.score(t))
    # every context's probabilities, the unseen word included, sum to one
    for context in ((b"the",), (b"the", b"cat"), (b"zzz",), (language_model.START, b"the"), ()):
        assert sum(model.p(context, w) for w in [*model.words, b"never seen"]) == pytest.approx(1)
    last = len(texts) - 1
    once = max(got[i]["score"] / got[i]["n_tokens"] for i in range(len(EDGES) + 60, last - 1))
    assert got[last]["score"] / got[last]["n_tokens"] > once + 0.3
    # rows without an id, repeated rows, blocks of any size, nothing to learn from, nothing to score
    more = df.unionByName(df.where("doc_id = 30")).unionByName(docs(spark, ["the cat"]).withColumn("doc_id", F.lit(None).cast("bigint")))
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 100)
    small = language_model.language_model_scores(df.repartition(5), held).collect()
    assert {(r["doc_id"], round(r["score"], 6)) for r in small} == {(i, round(r["score"], 6)) for i, r in got.items()}
    assert language_model.language_model_scores(more, F.coalesce(held, F.lit(False))).count() == len(texts) + 2
    none = language_model.language_model_scores(docs(spark, ["a b", None]), F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"], round(r["score"], 9)) for r in none} == {(0, 0, 0.0)}
    assert language_model.language_model_scores(docs(spark, []), held).count() == 0


def block_automaton(texts, trained):
    """The automaton of one block that holds all texts, its words in order, and the model of the trained ones."""
    model = BruteModel([t for t, k in zip(texts, trained) if k])
    rows = [[language_model.START, *language_model.tokens(t)] for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for r in rows for w in r))}
    words, sizes = np.array([number[w] for r in rows for w in r], np.uint32), np.array([len(r) for r in rows])
    hashes = np.random.default_rng(3).integers(0, 1 << 63, len(number)).astype(np.uint64)
    grams = language_model.Grams(hashes, words, number[language_model.START], 3)
    flat = [w for r in rows for w in r]

    def counts(keys, at, n):
        return np.array([model.c[tuple(flat[i - n + 1 : i + 1])] for i in at[np.unique(keys, return_index=True)[1]]], float)

    c1 = np.array([model.c[(w,)] for w in number], float)
    return language_model.Automaton(c1, words, grams, counts(grams.pairs, grams.pair_at, 2), counts(grams.triples, grams.triple_at, 3), model.below), list(number), words, sizes, model


def test_backoff_automaton(monkeypatch):
    rng = np.random.default_rng(11)
    texts = [" ".join(f"u{x}" for x in rng.zipf(1.5, n) % 40) for n in (0, 1, 2, 3, 40, 700, 90, 90)] + ["new u1 u1 words u2"] * 2
    auto, names, words, sizes, model = block_automaton(texts, [True] * 8 + [False] * 2)
    # the states' names, by their arcs
    contexts = {0: ()} | {1 + i: (w,) for i, w in enumerate(names)}
    for key, to in zip(auto.arcs.tolist(), auto.target.tolist()):
        state, w = divmod(key, auto.words)
        if to > auto.words:
            contexts[to] = (contexts[state][-1], names[w])
    reached = {0, *auto.target.tolist()}
    assert max(reached) > auto.words and all(model.c[contexts[s]] >= 2 for s in reached - {0})
    for s in reached - {0}:
        k, c = language_model.KAPPA[len(contexts[s]) - 1], model.c[contexts[s]]
        assert contexts[int(auto.failure[s])] == contexts[s][1:]
        assert 10 ** auto.weight[s] == pytest.approx(k / (c - 1 + k))
    assert sorted(auto.arcs.tolist()) == auto.arcs.tolist() and auto.arcs[: auto.words].tolist() == list(range(auto.words))
    for key, p, to in zip(auto.arcs.tolist(), auto.score, auto.target.tolist()):
        state, w = divmod(key, auto.words)
        context = contexts[state]
        if names[w] != language_model.START:  # read at the root only, to begin
            assert p == pytest.approx(math.log10(model.p(context, names[w])))
        assert not context or model.c[(*context, names[w])] > 0
        longest = next((g for g in ((*context, names[w])[-2:], (names[w],)) if model.c[g] >= 2), ())
        assert contexts[to] == longest
    # a walk carries its state; stretches of any length give the same
    whole = auto.walk(words, sizes)
    starts = np.cumsum(sizes) - sizes
    assert np.add.reduceat(whole, starts) == pytest.approx([model.score(t) for t in texts])
    state, one = np.zeros(1, np.int64), []
    for w in words[starts[5] : starts[5] + sizes[5]]:
        state, p = auto.step(state, np.array([w]))
        one.append(p[0])
    assert whole[starts[5] + 1 : starts[5] + sizes[5]] == pytest.approx(one[1:])
    for stretch in (1, 2, 7):
        monkeypatch.setattr(language_model, "STRETCH", stretch)
        assert auto.walk(words, sizes) == pytest.approx(whole)


def test_character_trigrams():
    assert len(quality_rules.buckets("äöüß🙂", np.empty(0, np.uint64))[1]) == 3
    first, second = (quality_rules.buckets(t, np.empty(0, np.uint64))[1] for t in ("xäöü", "yäöü"))
    assert first[0] != second[0] and first[1] == second[1]


def test_registered_scores(spark, tmp_path):
    """The queries themselves: folds, verdicts, one row a document, no score from labels of the held-out fold."""
    texts, y = corpus(240, 7)
    texts = texts + EDGES + [texts[0]]
    y = np.r_[y, np.zeros(len(EDGES)), y[0]].astype(int)
    docs(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    folds = {"op1_compression": (3, 1, 0.5), "op4_language_model": (5, 1, None), "op9_toxicity": (4, 2, 0.3)}
    results = []
    for turn, flip in enumerate((False, True)):
        sf = tmp_path / str(turn)
        sf.mkdir()
        os.symlink(tmp_path / "documents.parquet", sf / "documents.parquet")
        held = {(m, k): [zlib.crc32(str(i).encode()) % m == k for i in range(len(texts))] for m, k, _ in folds.values()}
        rows = [(i, int(v) ^ (flip and held[3, 1][i]), int(v) ^ (flip and held[4, 2][i])) for i, v in enumerate(y)]
        spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int").write.parquet(str(sf / "labels.parquet"))
        got = {}
        for module, (name, (m, k, at)) in zip((compression_quality, language_model, toxicity), folds.items()):
            out = {r["doc_id"]: r for r in getattr(module, name)(spark, str(sf)).collect()}
            assert sorted(out) == list(range(len(texts)))
            assert all(r["held_out"] == held[m, k][i] for i, r in out.items())
            if at:
                assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= at) for r in out.values())
            assert out[0]["score"] == pytest.approx(out[len(texts) - 1]["score"]) or name == "op9_toxicity"
            got[name] = {i: r["score"] for i, r in out.items()}
        results.append(got)
    for name in folds:
        assert results[0][name] == pytest.approx(results[1][name], abs=1e-9)
