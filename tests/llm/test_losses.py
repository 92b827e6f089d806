"""Cases in which rows or columns once got lost."""

import pytest
from pyspark.sql import functions as F

from logloom.llm import chat, queries, sharding

SF = "/root/testdata/sf0.001"


def test_conversations_named_like_null(spark):
    rows = [(None, 1, "user", "of none"), ("null", 1, "user", "of null"), ("", 1, "user", "of empty"), (":1", 1, "user", "a"), ("=", 2, "assistant", "b")]
    messages = chat.chains(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    got = {r["tree"]: r["texts"] for r in chat.read_back(chat.formatted(messages)).collect()}
    assert got == {c: [t] for c, _, _, t in rows}


@pytest.mark.parametrize("weights", [{"a": 0, "b": 0}, {"a": -1}, {"c": 1}])
def test_weights_that_place_nothing(weights):
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 101, weights)


def test_weights_of_nought():
    table = sharding.lookup_table(["a", "b", "c"], 101, {"b": 0, "c": 3})
    assert 1 not in table and table.count(2) in (75, 76)


def test_sharding_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (None, "z")], "doc_id long, slot string")
    got = sharding.place(docs, ["a", "b"]).collect()
    assert len(got) == 4 and len({(r["doc_id"], r["slot"], r["shard_id"]) for r in got}) == 2


def test_pipeline_keeps_columns_that_a_model_names(spark):
    import corpus_pipeline

    docs = queries.table(spark, SF, "documents").withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id")) for c in ("score", "p_text", "p_page", "own_score")})
    kept = corpus_pipeline.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in ("score", "p_text", "p_page", "own_score"))


def test_texts_without_lines(spark):
    from logloom.llm import line_dedup

    rows = [(1, "alpha beta\nx\nalpha  beta", "a"), (2, "BETA alpha\n\nnew", "b"), (3, None, "c"), (4, "alpha beta", "d"), (5, "kept", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed_lines string").repartition(3)
    got = line_dedup.without_lines(docs, line_dedup.line_dedup(docs))
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"], r["removed_lines"]) for r in got.collect()} == {1: ("alpha beta\nx", "a"), 2: ("\nnew", "b"), 3: (None, "c"), 4: ("", "d"), 5: ("kept", None)}


def test_lines_of_unicode_and_long_texts(spark):
    """Line numbers and token sets as plain Python has them, over texts without words, breaks at either end, and a long one."""
    import random

    from logloom.llm import line_dedup

    draw = random.Random(2)
    pool = ["Ä", "ä", "wörd", "日本", "x", "", " ", "\t", " ", " ", "\r"]
    texts = ["\n".join(" ".join(draw.choice(pool) for _ in range(draw.randrange(5))) for _ in range(draw.randrange(6))) for _ in range(120)]
    texts += ["\n\n", "\na\n", "a", "\n", "  \n  a b c d e f  \n", "z q " * 100_000 + "\nz q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    lines = [(i, n, frozenset(w.lower() for w in __import__("re").split(r"[\x20\x09-\x0D]+", x) if w)) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    match = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = {i: [] for i in range(len(texts))}
    seen = []
    for i, n, s in lines:
        if s and any(match(s, t) for t in seen):
            want[i].append(n)
        seen.append(s)
    got = line_dedup.line_dedup(docs).collect()
    assert {r["doc_id"]: r["removed_lines"] for r in got} == want
    assert {r["doc_id"]: r["n_lines"] for r in got} == {i: t.count("\n") + 1 for i, t in enumerate(texts)}


def test_line_dedup_leaves_nothing_behind(spark):
    from logloom.llm import common, line_dedup

    from pathlib import Path

    names = lambda: {p.name for p in Path(common.shared_dir(spark).removeprefix("file://")).glob("logloom-*")}
    before = names()
    line_dedup.line_dedup(queries.table(spark, SF, "documents")).count()
    left = names() - before
    assert len(left) == 1 and left.pop().startswith("logloom-places")  # what the result itself reads


@pytest.mark.parametrize("n", [20, 45])
def test_links_of_near_copies_without_their_pairs(spark, n, monkeypatch):
    """Links of a large group of near copies, and of lines about it, are counted exactly from few pairs."""
    import random

    from logloom.llm import line_dedup

    draw, base, lines = random.Random(n), [f"b{i}" for i in range(n)], []
    for i in range(300):
        own = list(base)
        for _ in range(draw.randrange(1, 4)):
            own[draw.randrange(n)] = draw.choice([f"new{i}", f"b{draw.randrange(n)}", f"c{draw.randrange(9)}"])
        lines.append(" ".join(own))
    lines += [" ".join(draw.choice([b, f"d{i % 7}"]) for b in base) for i in range(60)] + lines[:5]
    sets = [frozenset(x.split()) for x in lines]
    match = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    want = [(any(match(sets[i], sets[j]) for j in range(i)), sum(match(x, y) for y in set(sets)) - 1) for i, x in enumerate(sets)]
    counts, made = {}, line_dedup.materialize

    def counted(df, tag):
        out = made(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = sorted(line_dedup.line_dedup(docs).collect(), key=lambda x: x["doc_id"])
    assert [(x["n_removed"] == 1, x["lines"][0]["n_links"]) for x in got] == want
    assert counts["homes"] >= 250
    assert counts["pairs"] < 0.1 * sum(k for _, k in want) / 2


def test_lines_of_common_words_need_little_disk(spark, monkeypatch):
    """Lines that share words but aren't near copies have no pivots; no cells lie on disk any more when tokens are compared."""
    import random
    from pathlib import Path

    import pyarrow.parquet as pq

    from logloom.llm import common, line_dedup

    draw, words = random.Random(5), [f"w{i}" for i in range(60)]
    lines = [" ".join(draw.sample(words, 12)) for _ in range(1000)] + ["a b c d e f g h i j", "a b c d e f g h i k", "x y"]
    sets = [frozenset(x.split()) for x in lines]
    match = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    want = [(any(match(sets[i], sets[j]) for j in range(i)), sum(match(x, y) for y in set(sets)) - 1) for i, x in enumerate(sets)]
    counts, at, made = {}, Path(common.shared_dir(spark).removeprefix("file://")), line_dedup.materialize
    before = {p.name for p in at.glob("logloom-*")}

    def counted(df, tag):
        out = made(df, tag)
        counts[tag] = out.count()
        if tag in ("tokens", "links"):
            own = [p for p in at.glob("logloom-*/*.parquet") if p.parent.name not in before]
            assert own and all("cells" not in pq.read_schema(p).names for p in own)
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(3)
    got = sorted(line_dedup.line_dedup(docs).collect(), key=lambda x: x["doc_id"])
    assert [(x["n_removed"] == 1, x["lines"][0]["n_links"]) for x in got] == want
    assert counts["pivots"] == 0 and counts["links"] == sum(k for _, k in want) / 2


def packed_rows(spark, sizes, targets, size=64):
    """Sources of so many one-token words each, packed; (source, start, length, sequence, offset) of the pieces."""
    from logloom.llm import packing

    rows = [(i * 1000 + d, " ".join(["a"] * n), source) for i, (source, ns) in enumerate(sizes.items()) for d, n in enumerate(ns)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.packed(docs, queries.tokenizer_path(), size=size, targets=targets).collect()
    names = {i: s for i, _, s in rows}
    assert sum(r["length"] for r in got) == sum(n + 1 for ns in sizes.values() for n in ns)
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = {}
    for s, o, n in places:
        assert o == at.get(s, 0)
        at[s] = o + n
    assert all(n == size for s, n in at.items() if s < max(at))
    for d in {r["doc_id"] for r in got}:
        own = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == d)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
    return [(names[r["doc_id"]], r["length"], r["sequence_id"]) for r in got], len(at)


@pytest.mark.parametrize("targets", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.7}, {"b": 0.25, "c": 0.75}, {"a": 0.1, "b": 0.1, "c": 0.1}])
def test_packing_to_targets(spark, targets):
    """Every window holds the targets while all sources last; then the others go on in their proportions."""
    sizes = {"a": [99] * 20, "b": [49, 149] * 10, "c": [9] * 300, "other": [199] * 4}
    pieces, n = packed_rows(spark, sizes, targets)
    total = {s: sum(x + 1 for x in v) for s, v in sizes.items()}
    rest = sum(v for s, v in total.items() if s not in targets)
    rate = {s: targets.get(s, max(1 - sum(targets.values()), 1e-9) * v / rest if rest else 0) for s, v in total.items()}
    left = dict(total)
    for w in range(n - 1):
        have = {s: sum(k for t, k, q in pieces if t == s and q == w) for s in total}
        active = [s for s in total if left[s] > have[s]]  # lasts beyond this window
        if len(active) == sum(v > 0 for v in left.values()):
            share = sum(rate[s] for s in active)
            assert all(abs(have[s] - 64 * rate[s] / share) <= 3 for s in active), (w, have)
        left = {s: left[s] - have[s] for s in total}


def test_packing_of_many_sources(spark, monkeypatch):
    """Thousands of sources: those with targets keep queues of their own."""
    from logloom.llm import packing

    monkeypatch.setattr(packing, "MAX_QUEUES", 16)
    sizes = {f"s{i}": [3] for i in range(2000)} | {"big": [999] * 4}
    pieces, n = packed_rows(spark, sizes, {"big": 0.25})
    by = [sum(k for t, k, q in pieces if t == "big" and q == w) for w in range(n - 1)]
    assert all(abs(x - 16) <= 2 for x in by[: 8000 * 4 // 3 // 64 - 2])


@pytest.mark.parametrize("targets", [{"a": 0}, {"a": -0.5}, {"a": 0.9, "b": 0.2}])
def test_targets_that_are_no_shares(targets):
    from logloom.llm import packing

    with pytest.raises(ValueError):
        packing.rates_of({"a": 5, "b": 5}, targets)


def test_components_of_near_copies_without_their_pairs(spark, monkeypatch):
    """Few pairs of a large group of near copies are made, and cells of the same sets are one; the components are exact."""
    import random

    from logloom.llm import jaccard_join, pivots

    draw, base = random.Random(5), [f"b{i}" for i in range(200)]
    docs = []
    for i in range(400):
        own = list(base)
        for _ in range(draw.randrange(1, 5)):
            own[draw.randrange(200)] = f"new{i}"
        docs.append(own)
    docs += [[f"c{i // 2} {j}".replace(" ", "x") for j in range(200)] + [f"d{i}"] for i in range(20)]
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in docs]
    root = list(range(len(sets)))
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in range(3):
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    made, rows, met = [], [], pivots._Space.met

    def counted(self, leaf, *more):
        out = met(self, leaf, *more)
        made.append(out.count())
        rows.append(leaf.filter(F.col("id").isin(pairs)).groupBy("id").count().agg(F.max("count")).first()[0] or 0)
        return out

    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    join = jaccard_join._Join(table, "doc_id", "text", 4, pivots.Threshold(85))
    pairs = [r["id"] for r in join.points.filter("doc >= 400").collect()]
    monkeypatch.setattr(pivots._Space, "met", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(table, k=4, least=85).collect()}
    for _ in range(3):
        root = [root[i] for i in root]
    assert got == dict(enumerate(root))
    assert sum(made) < 3 * len(links)
    assert max(rows) == 1


def test_packing_encodes_new_words_together(monkeypatch):
    """Words that aren't known yet take few calls of the tokenizer, and give the ids that whole texts have."""
    from logloom.llm import packing

    class Counted:
        def __init__(self, tokenizer):
            self.own, self.calls = tokenizer, 0

        def __getattr__(self, name):
            self.calls += name.startswith("encode")
            return getattr(self.own, name)

    texts = [" ".join(f"{'Xq' if i % 3 else 'zü'}{chr(97 + i)}{chr(97 + j)}le{',.;'[j % 3]}" for j in range(26)) for i in range(26)]
    texts += [None, "", " ", "It's 12 a\x1cb c\x0bd\u0085e f <|ENDofText|> g", "é ́x İK ſtart", " lead", "trail "]
    e = packing.Encoder(queries.tokenizer_path())
    e.tokenizer = Counted(e.tokenizer)
    want = [e.tokenizer.own.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    packed_ids = e(texts)
    assert [[int.from_bytes(x[i : i + 4], "little") for i in range(0, len(x), 4)] for x in packed_ids] == want
    assert e.tokenizer.calls < 40
    monkeypatch.setattr(packing, "CHUNK_BYTES", 1)
    assert packing.Encoder(queries.tokenizer_path())(texts) == packed_ids


def test_pairs_are_made_where_they_first_meet(spark):
    """Sets that share many cells make few pairs, and none that links is missing."""
    import random

    from logloom.llm import jaccard_join, pivots

    draw, base = random.Random(8), [f"b{i}" for i in range(200)]
    docs = []
    for i in range(40):
        own = list(base)
        own[draw.randrange(200)] = f"new{i}"
        docs.append(own)
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    t = pivots.Threshold(85)
    join = jaccard_join._Join(table, "doc_id", "text", 4, t)
    of = {r["id"]: r["doc"] for r in join.points.collect()}
    rows = join.cells(join.documents()).withColumnsRenamed({"cell": "region"}).withColumns({"home": F.lit(True), "size": F.lit(1000), "group": F.col("id")})
    met = lambda df: pivots._Space(join.points, join.measured, t).met(df, jaccard_join.FOLD_NAMES, False)
    made = [tuple(sorted((of[r["x"]], of[r["y"]]))) for r in met(rows).collect()]
    sets = [{tuple(w[j : j + 4]) for j in range(len(w) - 3)} for w in docs]
    links = {(i, j) for j in range(40) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert len(links) > 300 and links <= set(made)
    assert len(made) < 4 * len(set(made)) < met(rows.drop("e_0", "e_1")).count()  # the latter: as often as they meet
