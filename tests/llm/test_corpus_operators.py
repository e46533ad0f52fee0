"""Operators over pairs, passages, archives, and the pipeline, against brute force."""

import hashlib
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import blocks, components, decontamination, ngram_join, substring_dedup, warc
from tremorlake.llm.common import alnum_words, shared_dir

EXTRA = {"lang": "xx", "source": "s", "n_chars": 0, "block": 2, "mark": "m", "node": 1, "_at": 4, "_id": 5}


def docs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    return df.withColumns({k: F.lit(v) for k, v in EXTRA.items()}).withColumn("n_chars", F.char_length("text").cast("bigint"))


def words(rng, n, vocabulary=5000):
    return [f"w{i}" for i in rng.integers(0, vocabulary, n)]


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    texts = [None, "", " \n ", "one two", "ONE  two", "a b c d e", "x " * 200]
    for _ in range(12):
        base = words(rng, 120)
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.integers(0, 8)):
                copy[rng.integers(0, len(copy))] = f"e{rng.integers(1000)}"
            texts.append(" ".join(copy))
    return texts + texts[7:12]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def brute_components(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("slice_", [512, 2])
def test_ngram_join(spark, monkeypatch, slice_):
    monkeypatch.setattr(ngram_join, "SLICE", slice_)
    texts = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_searches_give_memory_back(monkeypatch):
    """A search over many shingles gives its memory back, so that workers of several stages fit into an executor; small ones don't spend time on it."""
    import pyarrow as pa

    given = []
    monkeypatch.setattr(ngram_join, "release", lambda: given.append(1), raising=False)
    for n, times in ((100, 0), (40_000, 1)):
        sets = [np.arange(i, i + n, dtype=np.int64) for i in range(4)]
        group = pa.table({"root": [1] * 4, "node": [1, 2, 3, 4], "n": [n] * 4, "shared": pa.array(sets, pa.list_(pa.int64())), "role": [2] * 4})
        assert ngram_join.search(group).num_rows == 3
        assert len(given) == times


def test_links_of_rows_without_id(spark):
    texts = near_copies(4)
    copies = docs(spark, [texts[i] + " more" for i in (7, 13, 18)]).withColumn("doc_id", F.lit(None).cast("bigint"))
    df = docs(spark, texts).unionByName(copies)
    lone = docs(spark, ["never seen words stand here alone", "never seen words stand here alone"]).withColumn("doc_id", F.lit(None).cast("bigint"))
    got = ngram_join.ngram_components(df.unionByName(lone)).select("doc_id", "component_id").collect()
    want = [root for _, root in brute_components(texts + [texts[i] + " more" for i in (7, 13, 18)])]
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == dict(enumerate(want[: len(texts)]))
    assert sorted((r["component_id"] for r in got if r["doc_id"] is None), key=str) == sorted([*want[len(texts) :], None, None], key=str)
    assert sorted(r[0] for r in ngram_join.one_of_each(df).select("doc_id").collect()) == sorted(i for i, t in enumerate(texts) if want[i] == i or not shingles(t))


def test_one_of_each(spark):
    texts = near_copies(1)
    df = docs(spark, texts)
    kept = ngram_join.one_of_each(df.unionByName(df.where("doc_id = 8")))
    want = {i for i, (n, root) in enumerate(brute_components(texts)) if root == i or n == 0}
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(want)
    assert set(kept.columns) == set(df.columns)
    assert ngram_join.one_of_each(docs(spark, [])).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (200, 100)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 100}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 60).astype(np.uint64)
    l, c, r = substring_dedup.compact_windows(h, np.array([0, 25]), np.array([25, 60]), 6)
    cover = defaultdict(list)
    for a, m, b in zip(l.tolist(), c.tolist(), r.tolist()):
        for i in range(a, m + 1):
            for j in range(m, b + 1):
                if j - i + 1 >= 6:
                    cover[i, j].append(m)
    spans = [(i, j) for lo, hi in ((0, 25), (25, 60)) for i in range(lo, hi) for j in range(i + 5, hi)]
    assert sorted(cover) == sorted(spans)
    assert all(m == [i + int(np.argmin(h[i : j + 1]))] for (i, j), m in cover.items())


def planted(seed=0):
    rng = np.random.default_rng(seed)
    passage, edited = words(rng, 60), words(rng, 80)
    texts = [" ".join(words(rng, 200, 10**6)) for _ in range(30)]
    for i in (3, 9, 20):
        w = texts[i].split()
        texts[i] = " ".join(w[:50] + passage + w[50:])
    for i, change in ((5, False), (12, True)):
        w, e = texts[i].split(), list(edited)
        if change:
            e[40] = "other"
        texts[i] = " ".join(w[:70] + e + w[70:])
    short = words(rng, 30)
    for i in (1, 2):
        texts[i] += " " + " ".join(short)
    return [*texts, None, "", "tiny text", "the " * 300]


def test_repeated_passages(spark):
    df = docs(spark, planted())
    got = substring_dedup.merged_passages(substring_dedup.repeated_passages(df)).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], tuple(r["holders"])) for r in got} == {(9, 50, 60, (3,)), (20, 50, 60, (3,)), (12, 70, 80, (5,))}


def spans_of(spark, texts):
    got = substring_dedup.merged_passages(substring_dedup.repeated_passages(docs(spark, texts))).collect()
    return {(r["doc_id"], r["first_word"], r["n_words"], tuple(r["holders"])) for r in got}


def test_second_copy_of_a_passage(spark):
    rng = np.random.default_rng(8)
    passage, a, b, c = words(rng, 80), words(rng, 90, 10**6), words(rng, 70, 10**6), words(rng, 60, 10**6)
    line = passage[10:40]  # stands in the document before the passage
    texts = [" ".join(a + passage), " ".join(b + passage + c + passage), " ".join(c[:30] + line + b[:20] + passage), " ".join(["x", "y"] * 300 + a[:5]), " ".join(["x", "y"] * 300 + b[:5])]
    got = spans_of(spark, texts)
    assert {(1, 70, 80, (0,)), (1, 210, 80, (0,)), (2, 80, 80, (0,))} <= got
    assert any(d == 4 and n >= 590 for d, _, n, _ in got)


@pytest.mark.parametrize("change", ["insert", "delete"])
def test_passages_with_inserted_and_deleted_words(spark, change):
    rng = np.random.default_rng(9)
    texts, want = [], {}
    for n, every in ((60, 30), (80, 40), (86, 43), (400, 40)):
        for _ in range(5):
            passage, (a, b, c) = words(rng, n, 10**6), (words(rng, 60, 10**6) for _ in range(3))
            edited = list(passage)
            for at in range(n - every, 0, -every):
                edited[at : at + (change == "delete")] = ["new"] if change == "insert" else []
            texts += [" ".join(a + passage), " ".join(b[:40] + edited + c)]
            want[len(texts) - 1] = (40, len(edited))
    got = defaultdict(list)
    for d, first, n, holders in spans_of(spark, texts):
        assert holders == (d - 1,) and want[d][0] <= first and first + n <= sum(want[d])
        got[d].append((first, n))
    assert sum(got[d] == [w] for d, w in want.items()) >= 17  # the min-hashes of a few differ


def test_earlier_document_with_a_part(spark):
    """The first holder of most min-hashes holds 40 of 50 words; the passage is verbatim in two later documents."""
    rng = np.random.default_rng(10)
    texts, want = [], set()
    for n, part in ((50, 40), (50, 35), (60, 40)):
        for _ in range(8):
            passage, (a, b, c) = words(rng, n, 10**6), (words(rng, 60, 10**6) for _ in range(3))
            texts += [" ".join(a + passage[:part]), " ".join(b + passage), " ".join(c[:30] + passage + c[30:])]
            want.add((len(texts) - 1, 30, n, (len(texts) - 2,)))
    assert {x for x in spans_of(spark, texts) if len(x[3]) == 1 and x[3][0] % 3 == 1} == want


@pytest.mark.parametrize("edit", ["insert", "delete", "replace"])
def test_edited_copies_behind_a_part(spark, edit):
    """An earlier document holds 40 words of a passage, two later ones edited copies of all of it; brute-force Jaccard decides what has to be found."""
    rng = np.random.default_rng(11)
    texts, want = [], {}
    for n in (60, 80, 120):
        for _ in range(10):
            passage, (a, b, c) = words(rng, n, 10**6), (words(rng, 60, 10**6) for _ in range(3))
            edited = list(passage)
            at = int(rng.integers(20, n - 20))
            edited[at : at + (edit != "insert")] = [] if edit == "delete" else ["new"]
            texts += [" ".join(a + passage[:40]), " ".join(b + passage), " ".join(c[:30] + edited + c[30:])]
            x, y = shingles(" ".join(passage)), shingles(" ".join(edited))
            assert 100 * len(x & y) >= 75 * len(x | y)
            want[len(texts) - 1] = set(range(30, 30 + len(edited)))
    got = defaultdict(set)
    for d, first, n, _ in spans_of(spark, texts):
        got[d].update(range(first, first + n))
    assert all(got[d] <= w for d, w in want.items())
    assert sum(len(got[d]) >= 0.9 * len(w) for d, w in want.items()) >= 0.9 * len(want)


@pytest.mark.parametrize("block_bytes", [1, 1 << 30])
def test_size_of_blocks_does_not_matter(spark, monkeypatch, block_bytes):
    """A block sends what its documents share once; a block per row and one block of all rows agree with brute force."""
    for module in (ngram_join, substring_dedup):
        monkeypatch.setattr(module, "pack", lambda df, *extra: blocks.pack(df.repartition(64) if block_bytes == 1 else df.coalesce(1), *extra, block_bytes=block_bytes))
    line = " ".join(f"line{i}" for i in range(60))
    texts = [f"{line} " + " ".join(f"d{d}w{i}" for i in range(10)) for d in range(12)] + ["alone " * 3, None]
    got = substring_dedup.merged_passages(substring_dedup.repeated_passages(docs(spark, texts))).collect()
    assert {(r["doc_id"], r["first_word"], r["n_words"], tuple(r["holders"])) for r in got} == {(d, 0, 60, (0,)) for d in range(1, 12)}
    found = ngram_join.ngram_components(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in found] == brute_components(texts)


def test_cutting_passages(spark):
    texts = planted(1)
    df = docs(spark, texts)
    out = {r["doc_id"]: r for r in substring_dedup.without_passages(df).collect()}
    assert set(out) == set(range(len(texts))) and set(out[0].asDict()) == set(df.columns)
    for i, t in enumerate(texts):
        if i in (9, 20):
            assert out[i]["text"].split() == t.split()[:50] + t.split()[110:] and out[i]["n_chars"] == len(out[i]["text"])
        elif i != 12:
            assert out[i]["text"] == t
    assert substring_dedup.without_passages(docs(spark, [])).count() == 0
    assert substring_dedup.remove_words(" a b  c\nd", [(1, 2)]) == " a d"


def brute_contamination(text, items):
    w, hit, found = alnum_words(text or ""), set(), set()
    for item, t in items:
        b = alnum_words(t or "")
        for win in {tuple(b[i : i + 10]) for i in range(max(1, len(b) - 9))} if b else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(words(rng, 25))) for i in range(12)] + [(50, "Short item, here"), (51, ""), (52, None), (53, "!!! ..."), (7, "Short item here")]
    texts = [" ".join(words(rng, 100)) for _ in range(20)]
    texts[2] += " " + items[1][1].upper()
    texts[4] = texts[4] + " " + " ".join(items[2][1].split()[5:17]) + " x " + " ".join(items[3][1].split()[:10])
    texts[6] += " " + " ".join(items[5][1].split()[:9])
    texts[8] += " short ITEM - here short item here"
    near = items[6][1].split()[:10]
    near[4] = "changed"
    texts[10] += " " + " ".join(near)
    texts += [None, "", "é É short item here", "a" * 5000]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string").withColumn("phrase", F.lit(1))
    got = {r["doc_id"]: r for r in decontamination.contamination(df.unionByName(df.where("doc_id = 2")), bench).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_contamination(t, items), i
    assert got[10]["n_near"] == 1
    clean = decontamination.uncontaminated(df, bench)
    assert {r[0] for r in clean.select("doc_id").collect()} == {i for i in range(len(texts)) if not got[i]["contaminated"]}
    assert decontamination.contamination(df, bench.where("false")).where("contaminated").count() == 0
    assert decontamination.contamination(docs(spark, []), bench).count() == 0


def test_blocks_of_benchmark_agree(spark, monkeypatch):
    items = [(i, " ".join(f"a{i}b{k}" for k in range(14))) for i in range(6)]
    df, bench = docs(spark, [items[i][1] for i in (0, 3)] + ["none"]), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 7)
    assert [r["n_items"] for r in decontamination.contamination(df, bench).orderBy("doc_id").collect()] == [1, 1, 0]
    shared = spark.createDataFrame([(i, items[0][1]) for i in range(9)], "item_id bigint, text string")  # one window, many items
    assert [r["n_items"] for r in decontamination.contamination(df, shared).orderBy("doc_id").collect()] == [9, 0, 0]


def test_warc(spark):
    big = "<html>" + "é" * 200
    rows = [(5, "http://a", big), (3, "http://b\nc", big), (9, None, big), (None, "http://n", big), (1, "u", "short"), (2, "u", "short"), (4, "v", None), (6, "w", "y" * 100), (6, "w", "y" * 100), (8, "x", "y" * 100)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record_type", F.lit("?")).withColumn("_salt", F.lit(1))
    path = f"{shared_dir(spark)}-test"
    warc.write_archives(pages, path)
    back = sorted(warc.read_archives(spark, path).collect(), key=repr)
    assert len(back) == len(rows)
    for r in back:
        html = next(h for p, u, h in rows if p == r["page_id"] and u == r["url"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha256(html.encode()).hexdigest()
        assert r["payload"] == (html if r["record_type"] == "response" else None)
    kind = {(r["page_id"], r["url"]): (r["record_type"], r["refers_to"]) for r in back}
    assert kind[3, "http://b\nc"] == ("response", None) and kind[5, "http://a"] == ("revisit", 3) and kind[None, "http://n"] == ("revisit", 3)
    assert kind[1, "u"] == kind[2, "u"] == ("response", None) and kind[8, "x"] == ("revisit", 6) and kind[6, "w"] == ("response", None)
    pruned = warc.read_archives(spark, path, payload=False).where("record_type = 'revisit' and refers_to in (3, 4)")
    assert sorted(r["page_id"] or 0 for r in pruned.collect()) == [0, 5, 9]
    empty = f"{shared_dir(spark)}-none"
    warc.write_archives(pages.where("false"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_pipeline(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = np.random.default_rng(6)
    texts = planted(2)[:30] + near_copies(3)[7:17]
    toxic = [int(x) for x in rng.random(len(texts)) < 0.0]
    texts += [" ".join(words(rng, 60, 10**6)) + " awfulword" for _ in range(60)] + [" ".join(words(rng, 60, 10**6)) for _ in range(60)]
    toxic += [1] * 60 + [0] * 60
    item = " ".join(words(rng, 20))
    texts.append(" ".join(words(rng, 50)) + " " + item)
    toxic.append(0)
    df = docs(spark, texts)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    roots = [r for _, r in brute_components(texts)]
    want = {i for i in range(len(texts)) if not toxic[i] and roots[i] == i and i != len(texts) - 1}
    assert out == want


def foreign_archive(folder, damage=lambda data: data):
    import gzip

    os.makedirs(folder)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    blocks = [("warcinfo", "application/warc-fields", b"software: none\r\n"), ("response", "application/http; msgtype=response", http + b"<p>one</p>\r\n\r\n"), ("response", "application/http; msgtype=response", http + b"\xff two")]
    data = b""
    for i, (kind, content, block) in enumerate(blocks):
        top = f"WARC/1.0\r\nWARC-Type: {kind}\r\nwarc-target-uri: http://x/%20{i}\r\nContent-Type: {content}\r\nContent-Length: {len(block)}\r\n\r\n"
        data += gzip.compress(top.encode() + block + b"\r\n\r\n")
    with open(f"{folder}/crawl.warc.gz", "wb") as f:
        f.write(damage(data))
    return "file://" + str(folder)


def test_warc_of_another_writer(spark, tmp_path):
    rows = warc.read_archives(spark, foreign_archive(tmp_path / "a")).collect()
    assert [(r["record_type"], r["url"], r["payload"]) for r in rows] == [("warcinfo", "http://x/%200", None), ("response", "http://x/%201", "<p>one</p>\r\n\r\n"), ("response", "http://x/%202", "\ufffd two")]
    assert [r["payload_digest"] for r in rows[1:]] == [hashlib.sha256(b).hexdigest() for b in (b"<p>one</p>\r\n\r\n", b"\xff two")]
    assert warc.read_archives(spark, "file://" + str(tmp_path / "a")).where("record_type = 'warcinfo'").count() == 1
    for name, damage, says in (("cut", lambda d: d[:-20], "cut off"), ("no", lambda d: d + b"text", "no gzip member")):
        with pytest.raises(Exception, match=says):
            warc.read_archives(spark, foreign_archive(tmp_path / name, damage)).collect()


def test_warc_damage(spark, tmp_path):
    good = warc.record(1, "u", "<p>" + "text " * 40, "response", None)
    for name, data, says in (("cut", good[:-9], "cut off"), ("sum", good[:-8] + b"\0\0\0\0" + good[-4:], "checksum")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc.gz").write_bytes(good + data)
        with pytest.raises(Exception, match=says):
            warc.read_archives(spark, "file://" + str(tmp_path / name)).collect()


@pytest.mark.parametrize("edit", ["none", "replace"])
def test_edited_copies_of_a_middle_document(spark, monkeypatch, edit):
    """The first document and the one before hold a part of a passage each; one between them holds all of it, edited. No min-hash decides."""
    monkeypatch.setattr(substring_dedup, "MIN_HASHES", substring_dedup.HASHES)
    rng = np.random.default_rng(12)
    texts, want = [], {}
    for _ in range(15):
        passage, sides = words(rng, 60, 10**6), [words(rng, 60, 10**6) for _ in range(4)]
        edited = list(passage)
        if edit == "replace":
            edited[30] = "new"
        texts += [" ".join(sides[0] + passage[:35]), " ".join(sides[1] + edited), " ".join(sides[2] + passage[15:]), " ".join(sides[3][:30] + passage + sides[3][30:])]
        want[len(texts) - 1] = set(range(30, 90))
    got = defaultdict(set)
    for d, first, n, _ in spans_of(spark, texts):
        got[d].update(range(first, first + n))
    assert {d: got[d] for d in want} == want


def test_what_open_windows_ask(spark, monkeypatch):
    """Near copies with edits of their own: documents that hold a passage first ask nothing, others only for what reaches words not found; whether asked values are listed or joined doesn't matter."""
    rng = np.random.default_rng(13)
    base = words(rng, 150, 10**6)
    texts = []
    for _ in range(40):
        copy = list(base)
        for at in rng.integers(0, len(copy), 6):
            copy[at] = f"e{rng.integers(6)}"
        texts.append(" ".join(copy))
    texts += [" ".join(words(rng, 60, 10**6)) for _ in range(20)]
    texts += texts[40:]
    staged, stage = defaultdict(list), substring_dedup.stage
    monkeypatch.setattr(substring_dedup, "stage", lambda df, name: staged[name].append(out := stage(df, name)) or out)
    got = spans_of(spark, texts)
    assert {x[0] for x in got if x[0] >= 40} == set(range(60, 80))
    assert not staged["left"][0].where("doc_id >= 40").count()
    monkeypatch.setattr(substring_dedup, "LISTED", 0)
    assert spans_of(spark, texts) == got


def test_windows_ask_what_any_useful_holder_has():
    """Brute force over random holders of a stretch: whoever holds 40 of a window and reaches a word not found has an asked shingle."""
    rng = np.random.default_rng(14)
    for _ in range(200):
        n = int(rng.integers(46, 110))
        held, value = rng.integers(1, 6, n).astype(np.uint8), rng.permutation(n).astype(np.int64)
        held[rng.random(n) < 0.8] = rng.integers(2, 200)
        known = np.zeros(n + 4, bool)
        for a in rng.integers(0, n, 2):
            known[a : a + int(rng.integers(0, 60))] = True
        p = substring_dedup.open_windows(held > 1, known)
        asks = set(substring_dedup.rarest(p, held, np.where(held > 1, held.astype(np.int64), 256) << 32 | value, known).tolist())
        for _ in range(40):
            has = held > 1
            a = int(rng.integers(0, n))
            has[a : a + int(rng.integers(0, 9))] = False
            has[: int(rng.integers(0, n))] &= rng.random() < 0.5
            for w in p.tolist():
                m = w + np.flatnonzero(has[w : w + 46])
                if len(m) >= 40 and not known[m[0] : m[-1] + 5].all():
                    assert asks & set(m.tolist())
