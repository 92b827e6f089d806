"""Links between sets of a metric space (Jaccard distance) through pivots, Voronoi regions and triangle-inequality windows.

The space comes covered by cells: sets that link share one. A cell is the first region. With T the link threshold:

* A region of more than LEAF sets gets several pivots, up to PIVOTS, none near another. Each set's distance to the pivots of
  its region is measured unless bitmaps show that it is over 2 T.
* A set belongs to the region of its nearest pivot. It visits the region of any other pivot that is at most 2 T further than
  its own. Sets over T from all pivots go to the rest region, with others of the kind.
* No link is lost. For sets x, y within T of each other, with x at home at p and y at q, the triangle inequality gives
  d(x, q) <= d(y, q) + T <= d(y, p) + T <= d(x, p) + 2 T, so x visits q if that distance was measured; if it was not, then
  d(x, q) > 2 T, so d(y, q) > T and y is in the rest region. The same holds with x and y exchanged, so the two either meet in
  the region of one of them or both in the rest. A set without any pivot in reach is over 2 T from all, so what links with it
  is over T from all: they meet in the rest.
* Pivots have met all others of their region and leave it. A region whose sets all link with one pivot is done; others recur.
* Regions of at most LEAF sets, and those that the last pivots did not halve (their sets lie apart from all of them), are
  leaves: the pairs of which one set is at home, that are not yet connected, and that sizes, places and bitmaps let link, are
  measured. Leaves of more sets are cut into blocks that meet under keys of their own.
* Leaves are read twice. First some of them show links inside small blocks of their sets, a number in proportion to the sets,
  and these connect most of a group of near copies; then all pairs that are still apart meet. So a group isn't made of all its
  pairs, nor a pair made again in each of the many cells that its sets share.
* Cells that hold the same sets are one: the first of them in the order of shingles, where each set's place is the earliest.
* Each set brings to a cell the last cells that it begins with before. If two sets have one of these in common they have met
  there, so the pair isn't made again: the first cell that they share has none before it, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import discard, materialize
from logloom.llm.components import components

#: Regions of so many sets at most are leaves.
LEAF = 32
#: Pivots of a region, at most.
PIVOTS = 8
#: A region that holds more than this share of its parent's sets was not split: it is a leaf of any size.
SPLIT = 0.5
#: Sets of a block of a large leaf, about: as many as one task compares with as many others in about a second, since each set is
#: copied once for each block of its leaf.
BLOCK = 4096
#: Of so many leaves one is read first, inside blocks of so many sets, about.
FIRST, FIRST_BLOCK = 4, 64


class Threshold:
    """Links have ``parts`` * intersection >= ``least`` * union."""

    def __init__(self, least: int, parts: int = 100):
        self.least, self.parts = least, parts

    def prefix(self, n: int) -> int:
        return n - -(-self.least * n // self.parts) + 1

    @property
    def distance(self) -> float:
        return 1 - self.least / self.parts

    def twice(self) -> Threshold:
        """The threshold at twice the distance."""
        return Threshold(max(0, 2 * self.least - self.parts), self.parts)

    def links(self, common: Column, nx: Column, ny: Column) -> Column:
        return self.parts * common >= self.least * (nx + ny - common)

    def possible(self, x: str, y: str) -> Column:
        """By sizes, and by what can follow a first common shingle at their places."""
        nx, ny, px, py = (F.col(f"{x}n"), F.col(f"{y}n"), F.col(f"{x}pos"), F.col(f"{y}pos"))
        return self.links(F.least(nx - px, ny - py), nx, ny)

    def sizes(self, x: str, y: str) -> Column:
        nx, ny = F.col(f"{x}n"), F.col(f"{y}n")
        return self.links(F.least(nx, ny), nx, ny)

    def near(self, x: str, y: str, bits: list[str]) -> Column:
        """By parity bitmaps: each shingle that only one set holds flips one bit, so different bits bound how many there are."""
        if not bits:
            return F.lit(True)
        differ = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in bits))
        both = F.col(f"{x}n") + F.col(f"{y}n")
        return (self.parts + self.least) * differ <= (self.parts - self.least) * both


def _side(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}{c}") for c in df.columns))


class _Space:
    """``points``: (id, n, b_0, b_1, ...), the sets with their sizes and parity bitmaps."""

    def __init__(self, points: DataFrame, measured: Callable[[DataFrame], DataFrame], threshold: Threshold):
        self.points, self.measured, self.t = points, measured, threshold
        self.bits = [c for c in points.columns if c.startswith("b_")]

    def reachable(self, pairs: DataFrame, t: Threshold) -> DataFrame:
        """Those of ``pairs`` (x, y) whose sizes and bitmaps let them be within ``t``."""
        own = self.points.select("id", "n", *self.bits)
        both = pairs.join(_side(own, "x_"), F.col("x") == F.col("x_id")).join(_side(own, "y_"), F.col("y") == F.col("y_id"))
        return both.filter(t.sizes("x_", "y_") & t.near("x_", "y_", self.bits)).select("x", "y")

    def distances(self, pairs: DataFrame, t: Threshold) -> DataFrame:
        """(x, y, d, link) of those of ``pairs`` that are within ``t``, from whole sets."""
        of = F.col("common"), F.col("nx"), F.col("ny")
        d = 1 - F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))
        return self.measured(pairs).filter(t.links(*of)).select("x", "y", d.alias("d"), self.t.links(*of).alias("link"))

    def chosen(self, rows: DataFrame) -> DataFrame:
        """(region, pivot): of each region the sets with least hashes in PIVOTS slots, without those near an earlier one; sets
        that link with an earlier pivot come last."""
        slot = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(PIVOTS))
        order = F.struct((F.col("group") != F.col("id")).alias("linked"), F.xxhash64("id").alias("hash"))
        drawn = rows.groupBy("region", slot.alias("slot")).agg(F.min(F.struct(order.alias("h"), F.col("id"))).alias("least"))
        drawn = drawn.select("region", "least.h", F.col("least.id").alias("pivot"))
        own = self.points.select(F.col("id").alias("id2"), F.col("n").alias("size"), F.array(*self.bits).alias("bits"))
        listed = drawn.join(own, F.col("pivot") == F.col("id2")).groupBy("region").agg(F.array_sort(F.collect_list(F.struct("h", "pivot", "size", "bits"))).alias("all"))
        differ = lambda a, b: F.aggregate(F.zip_with(a["bits"], b["bits"], lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)
        close = lambda a, b: (self.t.parts + self.t.least) * differ(a, b) <= (self.t.parts - self.t.least) * (a["size"] + b["size"])
        kept = F.filter("all", lambda p, i: ~F.exists(F.slice(F.col("all"), F.lit(1), i), lambda q: close(p, q)))
        return listed.select("region", F.explode(F.transform(kept, lambda p: p["pivot"])).alias("pivot"))

    def to_pivots(self, rows: DataFrame, pivots: DataFrame) -> DataFrame:
        """(x, y, d, link): each set of a region with the pivots of the region that it may be within 2 T of."""
        lines = rows.join(_side(pivots, "p_"), (F.col("region") == F.col("p_region")) & (F.col("id") != F.col("p_pivot")))
        lines = lines.select(F.col("id").alias("x"), F.col("p_pivot").alias("y")).distinct()
        near = materialize(self.reachable(lines, self.t.twice()), "near")
        found = materialize(self.distances(near, self.t.twice()), "distances")
        discard(near)
        return found

    def split(self, rows: DataFrame, pivots: DataFrame, found: DataFrame) -> DataFrame:
        """The sets of all regions in the regions of pivots and in rest regions, but for pivots and regions of one group: sets
        that link with one pivot are a group, named by the first such pivot."""
        at = (F.col("region") == F.col("p_region")) & (F.col("id") == F.col("p_pivot"))
        out = rows.join(_side(pivots, "p_"), at, "left_anti")
        lines = rows.select("region", "id").join(_side(pivots, "p_"), F.col("region") == F.col("p_region"))
        far = lines.join(found, (F.col("id") == F.col("x")) & (F.col("p_pivot") == F.col("y"))).groupBy(F.col("region").alias("region2"), F.col("id").alias("id2"))
        far = far.agg(F.array_sort(F.collect_list(F.struct("d", F.col("y").alias("pivot"), "link"))).alias("to"))
        out = out.join(far, (F.col("region") == F.col("region2")) & (F.col("id") == F.col("id2")), "left")
        nearest = F.try_element_at("to", F.lit(1))
        place = lambda key, home: F.struct(F.xxhash64("region", key).alias("region"), home.alias("home"))
        window = nearest["d"] + 2 * self.t.distance + 1e-6  # a little too wide loses nothing
        visits = F.transform(F.filter("to", lambda p: p["d"] <= window), lambda p: place(p["pivot"], p["pivot"] == nearest["pivot"]))
        rest = F.when(F.col("to").isNull() | ~nearest["link"], F.array(place(F.lit("rest"), F.lit(True))))
        none = F.array().cast("array<struct<region:bigint,home:boolean>>")
        out = out.withColumn("at", F.explode(F.concat(F.coalesce(visits, none), F.coalesce(rest, none))))
        own = ["id", "n", "pos", *(c for c in rows.columns if c.startswith(("e_", "f_")))]
        out = materialize(out.select("at.region", "at.home", *own, F.col("size").alias("before"), F.when((F.col("group") == F.col("id")) & nearest["link"], nearest["pivot"]).otherwise(F.col("group")).alias("group")), "split")
        several = out.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("g1"), F.max("group").alias("g2")).filter("g1 != g2")
        held = out.join(_side(several.select("region", "size"), "s_"), F.col("region") == F.col("s_region"))
        held = materialize(held.select("region", "home", *own, F.col("s_size").alias("size"), "before", "group"), "open")
        discard(out)
        return held

    def grouped(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        """``rows`` with the components that the links of all pivots make as their groups; a set without links is its own."""
        known = rows.drop("group").join(groups, F.col("id") == F.col("node"), "left")
        return known.withColumn("group", F.coalesce("component", "id")).drop("node", "component")

    def met(self, rows: DataFrame, folds: list[str], first: bool) -> DataFrame:
        """All pairs (x, y) of different groups in a leaf that may link and haven't met in an earlier cell, one of them at home;
        ``first``: those inside small blocks of some leaves, those in leaves of several blocks also if they have met."""
        before = [c for c in rows.columns if c.startswith("e_")]
        if first:
            rows = rows.filter(F.pmod(F.xxhash64("region", F.lit(13)), F.lit(FIRST)) == 0)
        blocks = F.ceil(F.col("size") / (FIRST_BLOCK if first else BLOCK))
        rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), blocks))
        rows = rows.withColumn("other", F.col("block") if first else F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = rows.select("region", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "home", "id", "n", "pos", "group", "blocks", *before, *folds)
        x, y = _side(rows, "x_"), _side(rows, "y_")
        at = (F.col("x_region") == F.col("y_region")) & (F.col("x_lo") == F.col("y_lo")) & (F.col("x_hi") == F.col("y_hi"))
        once = (F.col("x_block") != F.col("y_block")) | (F.col("x_lo") == F.col("x_hi"))  # sets of one block meet under its own key only
        pair = (F.col("x_id") < F.col("y_id")) & (F.col("x_home") | F.col("y_home")) & (F.col("x_group") != F.col("y_group"))
        new = reduce(lambda a, b: a & b, (F.col(f"x_{a}") != F.col(f"y_{b}") for a in before for b in before), F.lit(True))
        new = new | (F.col("x_blocks") > 1) if first else new
        found = x.join(y, at & once & pair & new & self.t.possible("x_", "y_") & self.t.near("x_", "y_", folds))
        return found.select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))


def linked_points(held: DataFrame, points: DataFrame, measured: Callable[[DataFrame], DataFrame], threshold: Threshold, seen: list | None = None) -> DataFrame:
    """(node, component) of all sets that link with others.

    ``held`` has rows (cell, id, n, pos, f_0, f_1, ...) such that sets that link share a cell: n is the set's size, pos the
    cell's place in the set's order (one order for all sets), e_i, if any, the set's last cells before this one (its id where there
    is none), f_i parity bitmaps of fewer bits than those of ``points`` (id, n, b_0, b_1, ...).
    ``measured`` adds nx, ny and common to pairs (x, y). ``seen`` gets the number of pivots of each round.
    """
    space = _Space(points, measured, threshold)
    folds, before = ([c for c in held.columns if c.startswith(s)] for s in ("f_", "e_"))
    same = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"same_{seed}") for seed in (5, 6)]
    sizes = held.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.sum("pos").alias("places"), *same).filter("size > 1")
    sizes = sizes.groupBy("size", "same_5", "same_6").agg(F.min(F.struct("places", "cell")).alias("first")).select(F.col("first.cell").alias("cell"), "size")
    rows = held.join(_side(sizes, "s_"), F.col("cell") == F.col("s_cell"))
    rows = materialize(rows.select(F.col("cell").alias("region"), F.lit(True).alias("home"), "id", "n", "pos", *before, *folds, F.col("s_size").alias("size"), F.lit(None).cast("long").alias("before"), F.col("id").alias("group")), "open")
    leaves, spent, links = [], [], []
    unsplit = (F.col("size") <= LEAF) | F.coalesce(F.col("size") > SPLIT * F.col("before"), F.lit(False))
    while True:
        leaves.append(rows.filter(unsplit))
        spent.append(rows)
        large = rows.filter(~unsplit)
        if large.isEmpty():
            break
        pivots = materialize(space.chosen(large), "pivots")
        if seen is not None:
            seen.append(pivots.count())
        found = space.to_pivots(large, pivots)
        links.append(found)
        rows = space.split(large, pivots, found)
        discard(pivots)
    as_links = lambda df: df.select(F.col("x").alias("a"), F.col("y").alias("b"))
    groups = components(reduce(DataFrame.unionByName, (as_links(x.filter("link")) for x in links))) if links else _no_groups(held)
    discard(*links)
    for first in (True, False):
        met = materialize(reduce(DataFrame.unionByName, (space.met(space.grouped(leaf, groups), folds, first) for leaf in leaves)).distinct(), "met")
        near = materialize(space.reachable(met, threshold), "near")
        discard(met)
        found = materialize(space.distances(near, threshold), "links")
        discard(near)
        known = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
        groups, old = components(known.unionByName(as_links(found))), groups
        discard(old, found)
    discard(*spent)
    return groups


def _no_groups(held: DataFrame) -> DataFrame:
    kind = held.schema["id"].dataType.simpleString()
    return held.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
