"""Whitening, fill-in-middle and nearest neighbours against numpy, plain Python and brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logloom.llm import fill_middle, neighbours, queries, whitening

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, x string, n string, row string, id string, vector string, dim string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 6) for i, v in rows], VECTORS).repartition(3)


def expected_whitening(rows):
    good = [(i, [int(np.floor(np.float64(np.float32(c)) * 256)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), float)
    n, centred = len(fit), fit - fit.mean(0)
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    return good, n, fit.sum(0).astype(int).tolist(), fit.mean(0), values[::-1], parts[:, ::-1].T, np.trace(centred.T @ centred / n)


def test_whitening(spark):
    draw = np.random.default_rng(3)
    spread = np.array([3.0, 2.0, 1.5, 1.2, 0.4, 0.3, 0.2])
    rows = [(i, (draw.standard_normal(7) * spread).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1]), (201, None), (202, []), (203, [1.0, None, 2.0, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 7), (205, [float("inf")] * 7)]
    good, n, sums, mean, values, parts, trace = expected_whitening(rows)
    got = whitening.whitened(vectors_of(spark, [*rows, (206, [1.0, 2.0])])).collect()
    assert len(got) == 4 * len(good) and {r["n"] for r in got} == {n}
    by_id = {}
    for r in got:
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    signs = {}
    for i, x in good:
        for c in range(4):
            for r in by_id[i, c + 1]:
                assert r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
                want = (np.array(x) - mean) @ parts[c] / np.sqrt(values[c])
                sign = signs.setdefault(c, np.sign(want * r["whitened"]))
                assert abs(sign * r["whitened"] - want) < 1e-9
                assert abs(r["explained"] - values[c] / trace) < 1e-12 and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    assert whitening.whitened(vectors_of(spark, [])).collect() == []
    one = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["identity_error"] is None for r in one)
    flat = whitening.whitened(vectors_of(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])])).collect()
    assert {(r["vec_id"], r["component"], r["whitened"] is None) for r in flat} == {(1, 1, False), (2, 1, False), (1, 2, True), (2, 2, True)}
    large = [2**29, -(2**29), 5]
    assert whitening.deviations(np.array([large]), 1 << 30, [0, 0, 0]) == [None]
    assert whitening.deviations(np.array([[1000, 3, 5]]), 1000, [7, 8, 9]) == [sum((1000 * a - s) ** 2 for a, s in zip([1000, 3, 5], [7, 8, 9], strict=True))]


@pytest.mark.parametrize("case", ["random", "multiple", "diagonal", "blocks"])
def test_eigen(case):
    draw = np.random.default_rng(1)
    basis = np.linalg.qr(draw.standard_normal((40, 40)))[0]
    values = {"random": np.sort(draw.random(40))[::-1], "multiple": np.repeat([5.0, 3.0, 1.0, 0.0], 10), "diagonal": np.arange(40.0), "blocks": np.repeat([2.0, 1.0], 20)}[case]
    matrix = np.diag(values) if case in ("diagonal", "blocks") else (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    got, rows = whitening.eigen(matrix, 6)
    assert np.allclose(got, np.linalg.eigvalsh(matrix)[::-1][:6], atol=1e-12)
    assert np.allclose(rows @ rows.T, np.eye(6), atol=1e-11)
    assert np.abs(matrix @ rows.T - rows.T * got).max() < 1e-12


TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def transformed(i, text):
    text = text or ""
    units = TOKEN.findall(text)
    hexed = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(hexed[8 * j : 8 * j + 8], 16) for j in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    draw = random.Random(2)
    pool = ["a", "wörd", "日本", " ", "  ", "\n", "\t", "<P", "S>", "<", "\x1c", "\xa0", "😀x"]
    rows = [(i, "".join(draw.choice(pool) for _ in range(draw.randrange(40)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "x <P> y"), (504, "<M>"), (None, "one two  three "), (505, "lang " * 200_000), (505, "lang " * 200_000), (506, "x" * 300_000)]
    rows += [(i, "one two three four\n") for i in range(600, 640)]
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], "doc_id long, text string, n string, form string, output string").repartition(3)
    got = fill_middle.restore(fill_middle.fill_in_middle(docs)).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *transformed(i, t), t or "") for i, t in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(docs.limit(0))).collect() == []
    assert spark.createDataFrame([(None, "psm"), ("x", None)], "output string, form string").transform(fill_middle.restore).select("restored").distinct().collect() == [(None,)]


@pytest.mark.parametrize(("a", "b", "c"), [(0, 0, 5), (2, 5, 5), (0, 3, 9), (1, 200_001, 300_000)])
def test_rotation(a, b, c):
    data = bytearray(random.Random(a).randbytes(max(c, 10)))
    want = data[:a] + data[b:c] + data[a:b] + data[c:]
    view = np.frombuffer(data, np.uint8)
    fill_middle.rotate(view, a, b, c)
    assert bytes(view) == bytes(want)


def brute(rows, k, asks):
    usable = [(n, i, np.array(v, float)) for n, (i, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for n, i, q in usable:
        if asks(i):
            near = sorted((-float(np.add.reduce(v * q)), j is None, j or 0) for m, j, v in usable if m != n and len(v) == len(q))[:k]
            out.setdefault(i, []).append([(-s, None if none else j) for s, none, j in near])
    return out


def recall_of(got, want):
    by_query, hits, total = {}, 0, 0
    for r in got:
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    for i, lists in want.items():
        for near in lists:
            have = {(round(s, 9), j) for _, s, j in by_query.get(i, [])}
            hits, total = hits + sum((round(s, 9), j) in have for s, j in near), total + len(near)
    return hits / total


@pytest.mark.parametrize("block", [8192, 300])
def test_neighbours(spark, block, monkeypatch):
    """Long and short vectors, copies, repeated ids: many blocks and levels find what brute force finds."""
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "LEVEL", 3)
    draw = np.random.default_rng(4)
    base = draw.standard_normal((1500, 16)).astype(np.float32)
    base[:400] = base[0] + 0.05 * draw.standard_normal((400, 16))
    base[400:700] = base[400]
    base *= np.exp(0.2 * draw.standard_normal((1500, 1))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(3000, None), (3020, []), (3040, [0.0] * 16), (3060, [float("nan")] * 16), (3080, [None] * 16), (None, rows[40][1]), (40, rows[40][1]), (40, rows[41][1]), (20_000, [1.0, 2.0]), (7, [2.0, 1.0]), (20_020, [1.0] * 3)]
    tried = []
    got = neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") % 20 == 0, tried=tried).collect()
    want = brute(rows, 20, lambda i: i is not None and i % 20 == 0)
    assert recall_of(got, want) >= 0.93
    assert len(tried) == 1 if block > 1500 else len(tried) > 1
    assert [(r["rank"], r["vec_id"]) for r in got if r["query_id"] == 20_000] == [(1, 7)]
    assert not [r for r in got if r["query_id"] in (3000, 3020, 3040, 3060, 3080, 20_020)]
    lists = {}
    for r in got:
        lists.setdefault(r["query_id"], []).append(r)
    assert len(lists[40]) == 60 and all(len(v) == 20 for i, v in lists.items() if i not in (40, 20_000))
    for i, own in lists.items():
        if i == 40:
            continue
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
        keys = [(-r["score"], r["vec_id"] is None, r["vec_id"] or 0) for r in own]
        assert keys == sorted(keys)
    assert neighbours.nearest(vectors_of(spark, []), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_of_few_and_of_all(spark):
    rows = [(i, [float(i), 1.0]) for i in range(10)]
    got = neighbours.nearest(vectors_of(spark, rows), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == list(range(1, 10))


def test_neighbours_recall(spark):
    """The registered query finds at least nine of ten neighbours, and verifies a part of the vectors."""
    table = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    tried = []
    got = neighbours.nearest(table, F.col("vec_id") % 20 == 0, tried=tried).collect()
    assert len(got) == 20 * sum(i % 20 == 0 for i, _ in rows)
    assert recall_of(got, brute(rows, 20, lambda i: i % 20 == 0)) >= 0.93 and max(tried) < 0.5


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in queries.table(spark, SF, "embeddings").collect()]
    good, n, sums, mean, values, parts, trace = expected_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.op11_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(good)
    for c in range(4):
        want = np.array([(np.array(x) - mean) @ parts[c] / np.sqrt(values[c]) for _, x in good])
        have = np.array([got[i, c + 1]["whitened"] for i, _ in good])
        assert min(np.abs(want - have).max(), np.abs(want + have).max()) < 1e-8
