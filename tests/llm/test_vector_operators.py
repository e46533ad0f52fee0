"""Vector codes and whitening against brute force, with the edge cases that their modules define."""

import hashlib
import os

import duckdb
import numpy as np
import pytest

from tremorlake.llm import registry, vector_codes, whitening

SF = "/root/testdata/sf0.01"


def saved(spark, path, rows, schema="vec_id bigint, embedding array<float>, label int"):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def vectors(n, width=32, seed=0, scale=0.2):
    return np.random.default_rng(seed).normal(scale=scale, size=(n, width)).astype(np.float32)


def brute_codes(rows, entries=64, parts=16, rounds=2):
    """Codes, errors and codebooks by plain loops over whole distance tables."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v], y) for i, v, y in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    edges = vector_codes.cuts(len(kept[0][1]), parts)
    cut = lambda v: [tuple(v[a:b]) for a, b in zip(edges, edges[1:])]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda part, book: min((far(part, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for _, v, _ in kept:
                part = cut(v)[p]
                members.setdefault(best(part, books[p])[1], []).append(part)
            books[p] = [tuple(sum(c) // len(c) for c in zip(*members[k])) if k in members else e for k, e in enumerate(books[p])]
    out = [(i, "".join(f"{best(part, books[p])[1]:02x}" for p, part in enumerate(cut(v))), sum(best(part, books[p])[0] for p, part in enumerate(cut(v))), y) for i, v, y in kept]
    totals = {}
    for _, _, e, y in out:
        totals[y] = totals.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[y], digest) for i, c, e, y in out), key=repr)


def test_nearest_drops_entries_and_keeps_the_first_of_equal_ones():
    rng = np.random.default_rng(1)
    x, book = rng.integers(-60, 60, (500, 4)), rng.integers(-60, 60, (64, 4))
    book[40] = book[7]
    at, least, done = vector_codes.nearest(x, book)
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (at == whole.argmin(1)).all() and (least == whole.min(1)).all() and 40 not in at
    assert done < 0.6 * whole.size * 4
    far, _, _ = vector_codes.nearest(np.array([[2**39, -(2**39)]]), np.array([[0, 0], [2**39, -(2**39) + 1]]))
    assert far[0] == 1


def test_codes_match_brute_force(spark, tmp_path):
    v = vectors(150)
    rows = [(i, v[i].tolist(), None if i % 7 == 0 else 1 if i % 2 else i % 5) for i in range(150)]
    rows += [(900, None, 1), (901, [float("nan"), *v[0][1:].tolist()], 1), (902, [None, *v[0][1:].tolist()], 1), (903, [float("inf"), *v[0][1:].tolist()], 1)]
    rows += [(904, v[3].tolist(), 2), (904, v[3].tolist(), 2), (5, v[9].tolist(), None), (None, v[11].tolist(), 3), (905, [100000.0] * 32, 2), (906, [-0.0039] * 32, 2)]
    got = vector_codes.op11_vector_codes(spark, saved(spark, tmp_path, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes(rows)


def test_codes_of_few_ragged_and_clashing_rows(spark, tmp_path):
    v = vectors(9, 20)
    rows = [(i, x.tolist(), 1, 0.0, "a") for i, x in enumerate(v)] + [(50, [1.0] * 3, 1, 0.0, "b")]
    path = saved(spark, tmp_path / "a", rows, "vec_id bigint, embedding array<double>, label int, code double, Error string")
    got = vector_codes.op11_vector_codes(spark, path).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute_codes([r[:3] for r in rows[:-1]])
    for name, none in (("empty", []), ("nulls", [(1, None, 1)])):
        assert vector_codes.op11_vector_codes(spark, saved(spark, tmp_path / name, none)).collect() == []
        assert whitening.op13_whitening(spark, saved(spark, tmp_path / f"w{name}", none)).collect() == []
    assert vector_codes.op11_vector_codes(spark, saved(spark, tmp_path / "zero", [(1, [], 1)])).select("code", "error").first() == ("00" * 16, 0)


def test_codes_decode_to_their_entries(spark):
    v = vectors(100, 16)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    books = vector_codes.train(rows, parts=4, entries=8)
    coded = books.encode(rows, ["vec_id"])
    got = coded.join(books.decode(coded, ["vec_id"]), "vec_id").collect()
    assert len(got) == 100
    for r in got:
        x = np.floor(256 * v[r["vec_id"]].astype(float))
        assert ((x - 256 * np.array(r["embedding"])) ** 2).sum() == int(r["error"])


def test_sums_by_key_with_hot_and_null_keys(spark):
    rows = [(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}", i) for i in range(300)]
    got = vector_codes.sums_by_key(spark.createDataFrame(rows, "id int, k string, v bigint"), "k", "v", "s").collect()
    want = {}
    for _, k, v in rows:
        want[k] = want.get(k, 0) + v
    assert sorted(r["id"] for r in got) == list(range(300)) and all(r["s"] == want[r["k"]] for r in got)


def exact_whitening(rows, k=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in kept], float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    z = (n * u - s) / n
    e, w = np.linalg.eigh(z.T @ z / n)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ w / np.sqrt(e), e / np.trace(z.T @ z / n)


@pytest.mark.parametrize("decay,basis", [(0.75, 26), (0.999, 40)])
def test_whitening_is_exact_in_a_small_space_or_in_all(spark, tmp_path, decay, basis):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(600, 40)) * 2000 * decay ** np.arange(40)) @ np.linalg.qr(rng.normal(size=(40, 40)))[0]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(600 + i, v[0].tolist(), 1) for i in range(50)]
    rows += [(None, v[1].tolist(), 1), (7, v[2].tolist(), 1), (990, None, 0), (991, [float("nan")] * 40, 0), (992, [None] * 40, 0)]
    path = saved(spark, tmp_path, rows, "vec_id bigint, embedding array<double>, n int")
    assert whitening.fit(spark.read.parquet(f"{path}/embeddings.parquet")).basis == basis
    got = whitening.op13_whitening(spark, path).toPandas()
    n, far, want, share = exact_whitening([r[:2] for r in rows])
    assert len(got) == 652 * 16 and (got["n"] == n).all() and n == 600 and (got["identity_error"] < 1e-9).all()
    got = got[got["vec_id"].notna() & (got["vec_id"] != 7)].sort_values(["vec_id", "component"])
    at = [i for i, r in enumerate(rows[:650]) if r[0] != 7]
    white = got["whitened"].to_numpy().reshape(-1, 16)
    sign = np.sign((white * want[at]).sum(0))
    assert np.abs(white * sign - want[at]).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(-1, 16) == far[at][:, None]).all()
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), share, rtol=1e-9)


def test_whitening_without_variance(spark, tmp_path):
    assert whitening.op13_whitening(spark, saved(spark, tmp_path / "a", [(i, [1.0, 2.0], 0) for i in range(5)])).collect() == []
    rows = [(i, [1.0 * i, 2.0 * i, 5.0], 0) for i in range(4)] + [(9, [1.0], 0)]
    got = whitening.op13_whitening(spark, saved(spark, tmp_path / "b", rows)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(i, 1) for i in range(4)]
    assert all(abs(r["explained"] - 1) < 1e-12 for r in got)
    assert whitening.deviations(np.array([[2**40, 0]]), 2**30, [0, 0]) == [2**140]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_queries(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(registry.ORACLE_SQL["op11_vector_codes"]).fetchall())
    got = registry.QUERIES["op11_vector_codes"](spark, SF).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got)) == want
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    _, far, white, _ = exact_whitening(rows)
    got = registry.QUERIES["op13_whitening"](spark, SF).toPandas().sort_values(["vec_id", "component"])
    order = np.argsort([r[0] for r in rows])
    assert np.abs(np.abs(got["whitened"].to_numpy().reshape(-1, 16)) - np.abs(white[order])).max() < 1e-9
    assert (got["deviation"].to_numpy().reshape(-1, 16)[:, 0] == far[order]).all()
