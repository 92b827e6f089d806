"""N-gram Jaccard join in a metric space: documents link when their shingle sets are within a Jaccard distance.

Between unrelated documents every distance is 1, so pivots drawn from the whole table would tell nothing apart. The space is
therefore first covered by cells: a set of n shingles lies in the cells of its first n - ceil(s n) + 1 shingles, in one order
for all sets in which frequent shingles come last; two sets of similarity s or more share at least one cell. Inside the cells
pivots make Voronoi regions, triangle-inequality windows replicate sets at their boundaries, and regions recur (``pivots``).

Equal sets are one point of the space from the start, named by a 64-bit hash of the set as shingles are by theirs. Distances
are measured on whole sets, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import attach_groups, bloom_probe, bloom_words, discard, filter_bits, keep_or_drop, materialize
from logloom.llm.components import components
from logloom.llm.pivots import Threshold, linked_points
from logloom.llm.words import Alphabet, Words, chunks, grams, mix

#: Frequent shingles that are broadcast number so many at most (8 MB).
MAX_FREQUENT = 1 << 20
#: Shingles of all sets that meet at one home, about (4 MB).
HOME = 1 << 19


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``k`` words; a shorter text is one run."""
    gram = grams(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(gram[a : b - k + 1]))
        else:
            out.append(grams(words.hash[a:b], b - a) if b > a else gram[:0])
    return out


def _map_sets(rows: DataFrame, k: int, make, schema: str) -> DataFrame:
    """``make(ids, sets)`` of whole Arrow batches of (id, text)."""
    alphabet = Alphabet("space", fold=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, words in chunks(batch.column(1), alphabet):
                yield make(batch.column(0).slice(a, b - a), shingle_sets(words, k))

    return rows.mapInArrow(scan, schema)


#: Words of 64 bits in a parity bitmap of a set, and in the folded one that travels with its cells.
BITMAP, FOLD = 16, 4
BITMAP_NAMES = [f"b_{i}" for i in range(BITMAP)]
FOLD_NAMES = [f"f_{i}" for i in range(FOLD)]
#: Cells of a set that it takes along to its later ones.
BEFORE = 2
BEFORE_NAMES = [f"e_{i}" for i in range(BEFORE)]


def _bitmap(s: np.ndarray, words: int) -> np.ndarray:
    places = (s >> np.uint64(54)).astype(np.int64) % (64 * words)
    return np.packbits(np.bincount(places, minlength=64 * words) & 1 == 1).view(np.int64)


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    """A hash of each set: of the sum of mixed hashes of its shingles, and of their number."""
    return np.array([mix(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None] + np.uint64(len(s)))[0] for s in sets], np.uint64).view(np.int64)


def _signature(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
    bitmaps = np.array([_bitmap(s, BITMAP) for s in sets], np.int64).reshape(-1, BITMAP)
    return pa.RecordBatch.from_arrays([ids, pa.array(_keys(sets)), pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, np.ascontiguousarray(bitmaps.T))], ["doc", "id", "n", *BITMAP_NAMES])


def _slots(cells, bits: int):
    """Two places of a 64-bit hash in a filter of ``bits``; takes numpy arrays."""
    return (cells & np.uint64(bits - 1)).astype(np.int64), ((cells >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def _shifted(cell: np.ndarray, key: np.ndarray, row: np.ndarray, by: int) -> np.ndarray:
    """The cell ``by`` places earlier of the same row; its key where there is none."""
    out = key.copy()
    own = row[by:] == row[:-by]
    out[by:][own] = cell[:-by][own]
    return out


class _Join:
    """``keyed``: (doc, id, n, b_0, ...) of each row: the document's id, its point, the point's size and bitmap. ``points``:
    (id, doc, size, n, b_0, ...), the least document and the number of documents of each point."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, k: int, threshold: Threshold):
        self.k, self.t = k, threshold
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
        self.keyed = materialize(_map_sets(self.rows, k, _signature, f"doc {self.kind}, id long, n long, " + ", ".join(f"{b} long" for b in BITMAP_NAMES)), "sets")
        self.total = self.keyed.count()
        held = self.keyed.filter("n > 0 and doc is not null").groupBy("id")
        self.points = materialize(held.agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), *(F.first(b).alias(b) for b in BITMAP_NAMES)), "points")
        self.n_points = self.points.count()

    def of_all(self, points: DataFrame) -> DataFrame:
        """Each document (doc, n, id) with the columns of its point (id, size, ...)."""
        return attach_groups(self.keyed.select("doc", "n", "id"), points, "id", "size", self.total, F.xxhash64("doc", F.lit(5)))

    def documents(self) -> DataFrame:
        """(doc, text) of all documents but those that only copy others: whose points all have a lesser document."""
        own = self.of_all(self.points.select("id", "size", F.col("doc").alias("first"))).filter("first is not null").groupBy("doc")
        own = materialize(own.agg(F.bool_or(F.col("doc") == F.col("first")).alias("leads"), F.count(F.lit(1)).alias("n"), (F.min("id") != F.max("id")).alias("several")), "documents")
        copies = materialize(own.filter("not leads").select("doc"), "copies")
        n, self.several = own.agg(F.sum(F.when(F.col("leads"), F.col("n"))), F.coalesce(F.bool_or("several"), F.lit(False))).first()
        self.repeated = (n or 0) > self.n_points  # a point may come from several rows
        discard(own)
        return keep_or_drop(self.rows.filter("doc is not null"), copies, "doc", copies.count(), keep=False)

    def cells(self, docs: DataFrame) -> DataFrame:
        """(cell, id, n, pos, e_0, ..., f_0, ...): the shingles that begin each set, frequent ones last, and the last of them before
        each. Cells that only one set begins with are mostly left out, by a filter of the others."""
        t, spark = self.t, docs.sparkSession
        counted = "cell long, n long"

        def counts(cells: np.ndarray) -> pa.RecordBatch:
            cell, n = np.unique(cells, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(n.astype(np.int64))], ["cell", "n"])

        def first_ones(_: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            return counts(np.concatenate([s[: t.prefix(len(s)) * 5 // 4] for s in sets if len(s)] or [np.zeros(0, np.uint64)]))

        rows = self.points.agg(F.sum("n")).first()[0] or 0
        least = max(64, -(-(rows * (t.parts - t.least) * 5 // 4 // t.parts + self.total * 2) // MAX_FREQUENT))
        often = _map_sets(docs, self.k, first_ones, counted).groupBy("cell").agg(F.sum("n").alias("n")).filter(F.col("n") > least)
        held = materialize(often.select("cell"), "often")
        often = held.toArrow()["cell"].to_numpy()  # MAX_FREQUENT at most
        discard(held)
        frequent = spark.sparkContext.broadcast(np.sort(often.view(np.uint64)))

        def prefixes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            known, row, cell, pos = frequent.value, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, s in enumerate(sets):
                if not len(s):
                    continue
                if len(known):
                    late = known[np.minimum(np.searchsorted(known, s), len(known) - 1)] == s
                    s = np.concatenate([s[~late], s[late]])
                p = t.prefix(len(s))
                row.append(np.full(p, i)), cell.append(s[:p]), pos.append(np.arange(p))
            return np.concatenate(row), np.concatenate(cell), np.concatenate(pos)

        several = _map_sets(docs, self.k, lambda _, sets: counts(prefixes(sets)[1]), counted).groupBy("cell").agg(F.sum("n").alias("n")).filter("n > 1")
        several = materialize(several.select("cell"), "several")
        bits = filter_bits(several.count())
        slot = F.explode(F.array(F.col("cell").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("cell", 32).bitwiseAND(F.lit(bits - 1)))).alias("slot")
        words = several.select(slot).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask")).toArrow()  # bits / 64 at most
        table = np.zeros(bits // 64, np.uint64)
        table[words["word"].to_numpy()] = words["mask"].to_numpy().view(np.uint64)
        shared = spark.sparkContext.broadcast(table)
        discard(several)

        def begin(_: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            row, cell, pos = prefixes(sets)
            may = np.ones(len(cell), bool)
            for at in _slots(cell, bits):
                may &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            row, cell, pos = row[may], cell[may], pos[may]
            folds = np.array([_bitmap(s, FOLD) for s in sets], np.int64).reshape(-1, FOLD)
            size = np.array([len(s) for s in sets], np.int64)
            cell, key = cell.view(np.int64), _keys(sets)[row]
            before = [_shifted(cell, key, row, i + 1) for i in range(BEFORE)]
            return pa.RecordBatch.from_arrays([*map(pa.array, (cell, key, size[row], pos, *before, *np.ascontiguousarray(folds[row].T)))], ["cell", "id", "n", "pos", *BEFORE_NAMES, *FOLD_NAMES])

        out = _map_sets(docs, self.k, begin, "cell long, id long, n long, pos long, " + ", ".join(f"{f} long" for f in BEFORE_NAMES + FOLD_NAMES))
        return out.dropDuplicates(["cell", "id"]) if self.repeated else out

    def measured(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """(x, y, nx, ny, common) of ``pairs`` (x, y) of points, from the whole sets of both.

        Pairs meet at homes: the least point among x, y and their neighbours in ``pairs``. Points that are near one another
        mostly share a home, so a text travels about once, however many pairs its set stands in. Homes whose sets hold more than
        HOME shingles are cut into blocks of sets: pairs meet where their two blocks do.
        """
        both = pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(pairs.select(F.col("y").alias("a"), F.col("x").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        of = lambda c: least.select(F.col("a").alias(c), F.col("m").alias(f"m{c}"))
        homed = materialize(pairs.select("x", "y").join(of("x"), "x").join(of("y"), "y").select("x", "y", F.least("mx", "my").alias("home")), "homes")
        at = lambda df: df.select("home", F.explode(F.array("x", "y")).alias("id")).distinct()
        loads = at(homed).join(self.points.select("id", "n"), "id").groupBy("home").agg(F.sum("n").alias("load")).filter(F.col("load") > HOME)
        crowded = materialize(loads.select(F.col("home").alias("home2"), F.ceil(F.col("load") * 2 / HOME).alias("blocks")), "crowded")
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.col("blocks"))
        place = F.xxhash64("home", F.least(block("x"), block("y")), F.greatest(block("x"), block("y")))
        split = homed.join(crowded, F.col("home") == F.col("home2"), "left")
        split = materialize(split.select("x", "y", F.when(F.col("blocks").isNull(), F.col("home")).otherwise(place).alias("home")), "blocks")
        sent = materialize(at(split).join(self.points.select("id", "doc"), "id"), "sent")
        discard(homed, crowded)
        self.open += [split, sent]
        return self._at_homes(self._texts(docs, sent), split)

    def _texts(self, docs: DataFrame, sent: DataFrame) -> DataFrame:
        """(home, id, text) of all rows of ``sent`` (home, id, doc): texts travel, as they take less than their sets."""
        bits = filter_bits(sent.count())
        near = bloom_probe(docs, bloom_words(sent, "doc", bits), F.col("doc"), bits, "maybe").filter("maybe").select("doc", "text")
        return near.join(sent.select("home", "id", F.col("doc").alias("doc2")), F.col("doc") == F.col("doc2")).select("home", "id", "text")

    def _at_homes(self, texts: DataFrame, homed: DataFrame) -> DataFrame:
        """The pairs of each home, measured where its texts are: these come first, and their sets hold about HOME shingles. Of
        several texts of one document the one that is the point counts."""
        k, alphabet = self.k, Alphabet("space", fold=True)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, here, of = None, {}, ["x", "y", "nx", "ny", "common"]
            for batch in batches:
                found = []
                for a in range(0, batch.num_rows, 512):
                    own = batch.slice(a, 512)
                    sets = [s for _, _, words in chunks(own.column(3), alphabet) for s in shingle_sets(words, k)]
                    for s, key, home, x, y in zip(sets, _keys(sets).tolist(), *(own.column(c).to_pylist() for c in range(3)), strict=True):
                        if home != at:
                            at, here = home, {}
                        if y is not None:
                            u, v = here[x], here[y]
                            both = np.sort(np.concatenate([u, v]), kind="stable")
                            found.append((x, y, len(u), len(v), int(np.count_nonzero(both[1:] == both[:-1]))))
                        elif key == x:
                            here[x] = s
                table = np.array(found, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table.T], of)

        rows = texts.select("home", F.col("id").alias("x"), F.lit(None).cast("long").alias("y"), "text")
        rows = rows.unionByName(homed.select("home", "x", "y", F.lit(None).cast("string").alias("text")))
        return rows.repartition("home").sortWithinPartitions("home", F.asc_nulls_first("y")).mapInArrow(measure, "x long, y long, nx long, ny long, common long")

    def linked(self, seen: list | None = None) -> DataFrame:
        """(node, component) of the points that link with others, or that are texts of one document."""
        docs, self.open = self.documents(), []

        def measured(pairs: DataFrame) -> DataFrame:
            discard(*self.open)
            self.open = []
            return self.measured(docs, pairs)

        groups = linked_points(materialize(self.cells(docs), "cells"), self.points.select("id", "n", *BITMAP_NAMES), measured, self.t, seen)
        discard(*self.open)
        if not self.several:
            return groups
        own = self.keyed.filter("n > 0 and doc is not null").groupBy("doc").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a != z")
        texts = own.select("doc", "a").join(self.keyed.filter("n > 0").select("doc", F.col("id").alias("b")), "doc").select("a", "b")
        return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(texts))

    def points_in_components(self, seen: list | None = None) -> DataFrame:
        """(id, size, component) of all points: the least document of the points that are linked."""
        groups = self.linked(seen)
        own = self.points.select("id", "doc", "size").join(groups, F.col("id") == F.col("node"), "left").drop("node")
        linked = own.filter("component is not null")
        least = materialize(linked.groupBy("component").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("k")), "least")
        out = attach_groups(linked, least, "component", "k", self.n_points, F.xxhash64("id", F.lit(9))).select("id", "size", F.col("least").alias("component"))
        out = materialize(out.unionByName(own.filter("component is null").select("id", "size", F.col("doc").alias("component"))), "points")
        discard(groups, self.points)
        return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: int = 80, parts: int = 100, seen: list | None = None) -> DataFrame:
    """For each row of ``docs``: its id, n_shingles, component_id (the least id that links lead to, its own included).

    Words are runs of characters other than ASCII white space, with A-Z as a-z; a set holds a text's distinct runs of ``k``
    words, or the whole text as one run if it is shorter. Sets link when parts * intersection >= least * union. A text without
    words (empty or null) has no shingles and links with nothing: its component is its own id. A row without an id links with
    nothing and has no component. Rows with the same id are one document, which links as any of its texts does. An empty
    table gives an empty result. Other columns are ignored, whatever their names. ``seen``, a list, gets the number of pivots
    of each round.
    """
    join = _Join(docs, id_col, text_col, k, Threshold(least, parts))
    points = join.points_in_components(seen)
    return join.of_all(points).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, least: int = 80, parts: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component the document with the least id."""
    found = jaccard_components(docs, id_col, text_col, k, least, parts)
    dropped = materialize(found.filter(F.col(id_col) != F.col("component_id")).select(id_col), "copies")
    return keep_or_drop(docs, dropped, id_col, dropped.count(), keep=False)
