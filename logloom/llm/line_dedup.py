"""Line dedup: an exact set-similarity join of lines.

Equal token sets are one set from the start. The tokens of a line are ordered by rarity; a set of n tokens meets others only in
its first n - ceil(0.8 n) + 1 tokens (prefix filter), at places after which enough can follow (positional filter), if sizes
allow (length filter) and parity bitmaps differ in few bits. Every pair that passes is verified on 64-bit hashes of all tokens.
Cells of many sets are cut into blocks that meet pairwise under keys of their own.

Sets that lie near one pivot of a crowded cell share a home, and the links inside a home are counted without its pairs. With C the
tokens that most sets of the home hold, and D the tokens in which a set differs from C, two sets differ in |Dx| + |Dy| - 2 |Dx & Dy|
tokens. All sets of one size and one |D| therefore link at once with all of another where |Dx| + |Dy| is small enough; beyond
that, only sets whose D overlap can link, and these meet under the tokens of their D. This is exact whatever C and the home are.

Lines are cut into tokens, hashed and ordered in Arrow batches, a whole batch at once; grouping, cells, pairs and links are joins
and aggregates of Spark. (Built from DataFrame functions alone it took several times the CPU time that it may; see the README.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import attach_groups, bloom_probe, bloom_words, cleaned, discard, filter_bits, materialize, materialize_parts
from logloom.llm.pivots import Threshold
from logloom.llm.words import Alphabet, chunks, mix

#: Parity bitmaps of tokens in four parts.
WIDE = ("b_0", "b_1", "b_2", "b_3")
#: Token frequencies are counted in so many buckets by hash: the table that is broadcast has this size (a byte each) for any input.
BUCKETS = 1 << 20
#: Sets of a block of a cell, about: so many at most meet as many under one key.
BLOCK = 256
#: Two cells of more sets have pivots: so many at most, for the sets of which they are among the first or the last LOOKS such pairs.
CROWD, PIVOTS, LOOKS = 64, 4, 3
#: Lines and cells are shuffled in so many passes by hash, so that a part of them alone lies on disks besides what is written.
PASSES = 4
#: A home of fewer sets is none: its pairs are few.
LEAST_HOME = 16


class Lines:
    """Distinct tokens of all lines of a chunk of texts: ``hash`` by line, each line's from ``start``; its text and number."""

    def __init__(self, words, edges: np.ndarray):
        breaks = np.flatnonzero(words.data == 10)
        before = np.searchsorted(breaks, edges[:-1])  # line breaks before each text
        text = np.searchsorted(edges, words.start, side="right") - 1
        line = np.searchsorted(breaks, words.start)
        group = line + text  # a text begins a line of its own
        order = np.lexsort((words.hash, group))
        group, hashed = group[order], words.hash[order]
        first = np.ones(len(group), bool)
        first[1:] = (group[1:] != group[:-1]) | (hashed[1:] != hashed[:-1])
        group, self.hash, where = group[first], hashed[first], order[first]
        self.start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.start, len(group)))
        self.text = text[where][self.start]
        self.no = line[where][self.start] - before[self.text]

    def keys(self) -> pa.Array:
        """A line's set in 16 bytes: two sums over its tokens, whatever their order."""
        sums = [np.add.reduceat(mix(self.hash ^ np.uint64(salt)), self.start) for salt in (0x243F6A8885A308D3, 0x13198A2E03707344)]
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(self.start), [None, pa.py_buffer(np.stack(sums, 1).astype("<u8").tobytes())]).cast(pa.binary())

    def parity(self, part: int | None = None) -> np.ndarray:
        """A bitmap in which each token flips a bit; of four such bitmaps, to one of which each token belongs, the one named."""
        bit = np.uint64(1) << ((self.hash >> np.uint64(32)) & np.uint64(63))
        if part is not None:
            bit[(self.hash >> np.uint64(38)) & np.uint64(3) != part] = 0
        return np.bitwise_xor.reduceat(bit, self.start).view(np.int64)

    def lists(self, values: np.ndarray, take: np.ndarray) -> pa.Array:
        """The first ``take`` values of each line."""
        place = np.arange(len(values)) - np.repeat(self.start, self.size)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]), pa.int32()), pa.array(values[place < np.repeat(take, self.size)]))


def lines_of(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    """Rows with the lines of their texts, of which at least one holds a token."""
    alphabet = Alphabet("space", fold=False)
    for batch in batches:
        for a, b, words in chunks(batch.column(column), alphabet):
            if len(words.start):
                length = pc.fill_null(pc.binary_length(batch.column(column).slice(a, b - a)), 0).to_numpy()
                yield batch.slice(a, b - a), Lines(words, np.concatenate([[0], np.cumsum(length)]).astype(np.int64))


def _levels(texts: DataFrame) -> np.ndarray:
    """8 log2 of how often tokens of each bucket occur in lines, at most 254: BUCKETS bytes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, own in lines_of(batches, 0):
            total += np.bincount((own.hash & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    with cleaned(texts.sparkSession):
        counts = texts.select("low").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(BUCKETS, np.uint8)
    out[counts.column("bucket").to_numpy()] = np.minimum(254, np.round(8 * np.log2(counts.column("n").to_numpy())))
    return out


def _sets(texts: DataFrame, kind: str, t: Threshold) -> DataFrame:
    """(id, h, no, key, n, bits, cells) of each line with tokens; cells are its rarest tokens, as 8 bits of rarity and 54 of a
    hash."""
    sent = texts.sparkSession.sparkContext.broadcast(_levels(texts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch, own in lines_of(batches, 2):
            line = np.repeat(np.arange(len(own.start)), own.size)
            cell = (levels[(own.hash & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64) << 54) + (own.hash & np.uint64((1 << 54) - 1)).astype(np.int64)
            cell = cell[np.lexsort((cell, line))]
            prefix = own.size + (-t.least * own.size) // t.parts + 1  # n - ceil(n least / parts) + 1
            row = pa.array(own.text)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(own.no.astype(np.int32)), own.keys(), pa.array(own.size), pa.array(own.parity()), own.lists(cell, prefix)], ["id", "h", "no", "key", "n", "bits", "cells"])

    return texts.mapInArrow(scan, f"id {kind}, h long, no int, key binary, n long, bits long, cells array<long>")


def _tokens(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, tokens, b_0, ...) of the sets ``wanted`` (key): hashes of their tokens, of one line each, and their parity in 256 bits."""
    bits = filter_bits(wanted.count())
    with cleaned(wanted.sparkSession):
        filled = bloom_words(wanted.withColumn("key", F.xxhash64("key")), "key", bits).toArrow()  # at most bits / 64 rows
    masks = np.zeros(bits // 64, np.int64)
    masks[filled.column("word").to_numpy()] = filled.column("mask").to_numpy()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in lines_of(batches, 0):
            yield pa.RecordBatch.from_arrays([own.keys(), own.lists(own.hash.view(np.int64), own.size), *(pa.array(own.parity(i)) for i in range(4))], ["key", "tokens", *WIDE])

    words = wanted.sparkSession.createDataFrame(filled.select(["word", "mask"]))
    every = texts.select("low").mapInArrow(scan, f"key binary, tokens array<long>, {', '.join(f'{b} long' for b in WIDE)}")
    near = bloom_probe(every, words, F.xxhash64("key"), bits, "maybe").filter("maybe").select("key", "tokens", *WIDE)
    return near.join(wanted, "key", "left_semi").groupBy("key").agg(*(F.first(c).alias(c) for c in ("tokens", *WIDE)))


def _homes(sets: DataFrame, t: Threshold) -> DataFrame:
    """(id, home) of the sets that share a home: first the least pivot of their crowded pairs of cells, then the largest home of
    their cells, if they are near its pivot.

    Common words alone crowd ever more cells as a table grows, but not pairs of cells, which only near copies share in numbers:
    pairs are counted by themselves, and little but sets of near copies is looked at further.
    """
    common = F.filter("cells", lambda c: F.shiftright(c, 54) >= 8 * math.floor(math.log2(CROWD)))
    ends = lambda a: F.array_union(F.slice(a, 1, LOOKS), F.slice(F.reverse(a), 1, LOOKS))
    rest = F.size("common") - 1
    pairs = F.when(rest > 0, F.zip_with(F.slice("common", F.lit(1), rest), F.slice("common", F.lit(2), rest), lambda a, b: F.xxhash64(a, b))).when(rest == 0, F.array(F.xxhash64(F.col("common")[0], "n")))
    cells = sets.select("id", "n", "bits", F.explode(ends(common)).alias("cell"))
    wide = Threshold(max(0, t.least - (t.parts - t.least) // 2), t.parts)
    sized = sets.select(F.col("id").alias("home"), F.col("n").alias("yn"), F.col("bits").alias("ybits"))

    def near(rows: DataFrame, pivots: DataFrame, shared: int) -> DataFrame:
        """(id, home) of ``rows`` for ``pivots`` (cell2, home, yn, ybits): bitmaps of large sets tell less, so these share two
        cells, of which a row is ``shared``."""
        own = rows.select("cell", "id", F.col("n").alias("xn"), F.col("bits").alias("xbits"))
        met = own.join(pivots, (F.col("cell") == F.col("cell2")) & wide.sizes("x", "y") & wide.near("x", "y", ["bits"]))
        met = met.select("id", "home", ((F.col("xn") <= 64) | t.near("x", "y", ["bits"])).alias("close"))
        return met.groupBy("id", "home").agg((F.bool_or("close") | (shared * F.count(F.lit(1)) > 1)).alias("close")).filter("close").select("id", "home")

    def large(rows: DataFrame) -> DataFrame:
        return rows.groupBy("home").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= LEAST_HOME)

    some = sets.select("id", "n", "bits", common.alias("common")).select("id", "n", "bits", F.explode(ends(pairs)).alias("cell"))
    crowds = materialize(some.groupBy("cell").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select(F.col("cell").alias("crowd")), "crowds")
    held = materialize(some.join(crowds, F.col("cell") == F.col("crowd")).drop("crowd"), "held")
    slot = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    drawn = held.groupBy("cell").agg(*(F.min(F.when(slot == i, F.col("id"))).alias(f"p{i}") for i in range(PIVOTS)))
    pivots = drawn.select(F.col("cell").alias("cell2"), F.explode(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("home"))
    pivots = materialize(pivots.join(sized, "home"), "pivots")
    found = materialize(near(held, pivots, 2).groupBy("id").agg(F.min("home").alias("home")), "near")
    found2 = materialize(found.join(large(found), "home"), "large")
    tops = sets.join(found2, "id").select("home", "k", F.explode(ends(common)).alias("cell")).groupBy("cell", "home", "k").agg(F.count(F.lit(1)).alias("here")).filter("here > 3")
    tops = tops.groupBy("cell").agg(F.max(F.struct("k", "home")).alias("top")).select(F.col("cell").alias("cell2"), "top.k", "top.home")
    tops = materialize(tops.join(sized, "home"), "tops")
    again = near(cells, tops.drop("k"), 1).join(found2.select("home", "k").distinct(), "home").select("id", "k", "home")
    best = materialize(again.unionByName(found2.select("id", "k", "home")).groupBy("id").agg(F.max(F.struct("k", "home")).alias("top")).select("id", "top.home"), "best")
    out = materialize(best.join(large(best), "home", "left_semi").select("id", "home"), "homes")
    discard(crowds, held, pivots, found, found2, tops, best)
    return out


def _inside(members: DataFrame, firsts: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links inside homes, of ``members`` (id, home, tokens): (id, n_links, other) of those that sizes alone tell, other being the
    first line among them; (x, y) of the rest; what the former are read from."""
    total = members.count()
    sizes = members.groupBy("home").agg(F.count(F.lit(1)).alias("size"))
    often = members.select("home", F.explode("tokens").alias("token")).groupBy("home", "token").agg(F.count(F.lit(1)).alias("k")).filter(2 * F.col("k") > LEAST_HOME)
    core = sizes.join(often.select(F.col("home").alias("home2"), "token", "k"), (F.col("home") == F.col("home2")) & (2 * F.col("k") > F.col("size")), "left")
    core = materialize(core.groupBy("home", "size").agg(F.collect_list("token").alias("core")), "cores")
    rows = attach_groups(members, core, "home", "size", total, F.xxhash64("id", F.lit(13)))
    rows = rows.select("id", "home", F.size("tokens").cast("long").alias("n"), F.concat(F.array_except("tokens", "core"), F.array_except("core", "tokens")).alias("diff"))
    rows = rows.join(firsts, "id").withColumn("h", F.size("diff").cast("long"))
    rows = materialize(rows, "members")
    discard(core)
    links = lambda shared: t.links(F.col("xn") + F.col("yn") - F.col("xh") - F.col("yh") + 2 * shared, 2 * F.col("xn"), 2 * F.col("yn"))  # noqa: E731  (all sizes doubled)
    side = lambda df, s: df.select(*(F.col(c).alias(f"{s}{c}") for c in df.columns))
    bins = rows.groupBy("home", "n", "h").agg(F.count(F.lit(1)).alias("k"), F.min("first").alias("first"))
    met = side(bins, "x").join(side(bins, "y"), (F.col("xhome") == F.col("yhome")) & links(F.lit(0)))
    met = materialize(met.groupBy("xhome", "xn", "xh").agg(F.sum("yk").alias("k"), F.min("yfirst").alias("other"), F.bool_or((F.col("xn") == F.col("yn")) & (F.col("xh") == F.col("yh"))).alias("own")), "bins")
    sure = rows.join(F.broadcast(met) if met.count() <= 100_000 else met, (F.col("home") == F.col("xhome")) & (F.col("n") == F.col("xn")) & (F.col("h") == F.col("xh")))
    sure = sure.select("id", (F.col("k") - F.col("own").cast("long")).alias("n_links"), "other")
    apart = rows.select("home", "id", "n", "h", F.explode("diff").alias("token"))
    at = (F.col("xhome") == F.col("yhome")) & (F.col("xtoken") == F.col("ytoken")) & (F.col("xid") < F.col("yid"))
    pairs = side(apart, "x").join(side(apart, "y"), at & ~links(F.lit(0)) & links(F.least("xh", "yh")))
    pairs = pairs.groupBy("xid", "yid", "xn", "yn", "xh", "yh").agg(F.count(F.lit(1)).alias("shared")).filter(links(F.col("shared")))
    return sure, materialize(pairs.select(F.col("xid").alias("x"), F.col("yid").alias("y")), "inside"), [rows, met]


def _candidates(sets: DataFrame, t: Threshold) -> DataFrame:
    """All pairs (x, y) of sets in a cell, not of one home (-1: none), that the places, sizes and bitmaps let link.

    A cell holds at most as many sets as its rarity tells, so only cells of frequent tokens are counted; those of more than BLOCK
    sets are cut into blocks. Size, place and block travel as one number. Cells are read in passes; a pair that meets in several
    passes is told apart behind them.
    """
    each = sets.select("id", "n", "bits", "home", F.posexplode("cells").alias("pos", "cell"))
    frequent = F.expr("shiftright(cell, 54)") >= 8 * math.floor(math.log2(BLOCK))
    crowded = each.filter(frequent).groupBy("cell").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > BLOCK)
    crowded = materialize(crowded.select(F.col("cell").alias("cell2"), F.ceil(F.col("k") / BLOCK).alias("blocks")), "crowded")
    packed = lambda block: F.shiftleft("n", 32).bitwiseOR(F.shiftleft(F.least(F.col("pos"), F.lit((1 << 20) - 1)).cast("long"), 12)).bitwiseOR(block.bitwiseAND(F.lit(4095)).cast("long"))
    plain = lambda df: df.select(F.col("cell").alias("at"), "id", packed(F.lit(0).cast("long")).alias("own"), "bits", "home")
    cells_in_blocks = not crowded.isEmpty()

    def met(each: DataFrame) -> DataFrame:
        if not cells_in_blocks:
            rows = plain(each)
        else:
            cut = each.filter(frequent).join(crowded, F.col("cell") == F.col("cell2"), "left").withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), "blocks"))
            blocks = cut.filter("blocks is not null").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            blocks = blocks.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("at"), "id", packed(F.when(F.col("block") == F.col("other"), F.lit(0)).when(F.col("block") < F.col("other"), F.lit(1)).otherwise(F.lit(2)).cast("long")).alias("own"), "bits", "home")
            rows = plain(each.filter(~frequent)).unionByName(plain(cut.filter("blocks is null"))).unionByName(blocks)
        rows = rows.repartition("at")  # by itself, so that both sides of the join read the one shuffle
        x, y = (rows.select(*(F.col(c).alias(f"{s}{c}") for c in rows.columns)) for s in "xy")
        side = lambda s: (F.expr(f"shiftright({s}own, 32)").alias(f"{s}n"), F.expr(f"shiftright({s}own, 12) & 1048575").alias(f"{s}pos"), F.expr(f"{s}own & 4095").alias(f"{s}block"), F.col(f"{s}id"), F.col(f"{s}bits"))
        apart = (F.col("xhome") != F.col("yhome")) | (F.col("xhome") < 0)
        both = x.join(y, (F.col("xat") == F.col("yat")) & (F.col("xid") < F.col("yid")) & apart).select(*side("x"), *side("y"))
        once = (F.col("xblock") != F.col("yblock")) | (F.col("xblock") == 0)  # sets of one block meet under its own key only
        return both.filter(once & t.possible("x", "y") & t.near("x", "y", ["bits"])).select(F.col("xid").alias("x"), F.col("yid").alias("y")).distinct()

    parts = materialize_parts((met(each.filter(F.pmod("cell", F.lit(PASSES)) == i)) for i in range(PASSES)), "met")
    out = materialize(parts.distinct(), "pairs")
    discard(crowded, parts)
    return out


def _verified(texts: DataFrame, sets: DataFrame, homes: DataFrame, pairs: DataFrame, t: Threshold) -> tuple[DataFrame, DataFrame]:
    """Those of ``pairs`` (x, y) that link, from the tokens of both; (id, home, tokens) of sets with a home."""
    ids = lambda pairs: pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id")))
    wanted = materialize(sets.select("id", "key").join(ids(pairs).unionByName(homes.select("id")).distinct(), "id", "left_semi"), "measured")
    tokens = materialize(_tokens(texts, wanted.select("key")).join(wanted, "key").select("id", F.size("tokens").cast("long").alias("n"), *WIDE, "tokens"), "tokens")
    # the wide bitmaps leave few pairs that don't link, so that few tokens travel for nothing
    marks = lambda c: tokens.select(F.col("id").alias(c), *(F.col(x).alias(f"{c}{x}") for x in ("n", *WIDE)))
    near = materialize(pairs.join(marks("y"), "y").join(marks("x"), "x").filter(t.near("x", "y", list(WIDE))).select("x", "y"), "alike")
    some = materialize(tokens.select("id", "tokens").join(ids(near).distinct(), "id", "left_semi"), "compared")
    members = materialize(tokens.select("id", "tokens").join(homes, "id"), "at-home")
    discard(wanted, tokens)
    side = lambda c: some.select(F.col("id").alias(c), F.col("tokens").alias(f"s{c}"))
    both = near.join(side("y"), "y").join(side("x"), "x")
    size = lambda c: F.size(c).cast("long")
    out = materialize(both.filter(t.links(size(F.array_intersect("sx", "sy")), size("sx"), size("sy"))).select("x", "y"), "links")
    discard(near, some)
    return out, members


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 80, parts: int = 100) -> DataFrame:
    """(id, h, no, class_id, n_links, removed) of all lines that hold tokens; h is a hash of the document's text, no counts from 0,
    class_id has 16 bytes."""
    t = Threshold(least, parts)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.lower(text).alias("low"))
    wide = materialize(_sets(texts, docs.schema[id_col].dataType.simpleString(), t), "cells")
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("h"), F.col("no"))
    one = [F.first(c).alias(c) for c in ("n", "bits", "cells")]
    grouped = lambda rows: rows.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("size"), *one)
    some = lambda i: wide.filter(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(PASSES)) == i)
    sets = materialize_parts((grouped(some(i)).withColumn("id", F.monotonically_increasing_id() * PASSES + i) for i in range(PASSES)), "sets")
    lines = materialize(wide.select("id", "h", "no", "key"), "lines")  # cells of lines are needed no more
    discard(wide)
    homes = _homes(sets, t)
    at_home = sets.join(homes, "id", "left").withColumn("home", F.coalesce("home", F.lit(-1).cast("long")))
    pairs = _candidates(at_home, t)
    whole, sets = sets, materialize(sets.select("id", "key", "size", "first"), "heads")  # nor those of sets
    discard(whole)
    links, members = _verified(texts, sets, homes, pairs, t)
    sure, inside, read = _inside(members, sets.select("id", "first"), t)
    both = links.unionByName(inside)
    both = both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y")))
    # of each set with links: how many, and the first line of those that it links with
    met = both.join(sets.select(F.col("id").alias("y"), "first"), "y").select(F.col("x").alias("id"), F.lit(1).cast("long").alias("n_links"), F.col("first").alias("other")).unionByName(sure)
    met = met.groupBy(F.col("id").alias("id2")).agg(F.sum("n_links").alias("n_links"), F.min("other").alias("other"))
    heads = sets.select("id", "key", "size", "first").join(met, F.col("id") == F.col("id2"), "left")
    heads = materialize(heads.select("key", "size", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.least("first", F.coalesce("other", "first")).alias("head")), "linked")
    discard(sets, homes, pairs, links, members, inside, *read)
    spread = F.unhex(F.md5(F.concat_ws(" ", F.lit("line"), F.col("id").cast("string"), F.col("h").cast("string"), F.col("no").cast("string"))))
    out = attach_groups(lines, heads, "key", "size", lines.count(), spread)
    out = materialize(out.select("id", "h", "no", F.col("key").alias("class_id"), "n_links", (place != F.col("head")).alias("removed")), "places")
    discard(lines, heads)
    return out


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 80, parts: int = 100) -> DataFrame:
    """For each document: its id, n_lines, n_removed, removed_lines (their numbers from 0, in order), lines.

    Lines are what newlines part; tokens are the distinct words of a line between ASCII white space, lower-cased. Lines match
    when parts * intersection >= least * union; a line is removed when an earlier one matches it, whether that one stays or
    not: earlier by the smaller id, then the smaller number. ``lines`` has (no, class_id, n_links) of each line that holds
    tokens: lines of equal token sets are one class, and n_links counts the other classes that match it. Lines without
    tokens always stay. A null text is one empty line, like an empty one. Documents without an id come last. Rows with the
    same id and text are one document and get the same result each; with the same id and other texts they come in the order
    of a hash of the text. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = line_groups(docs, id_col, text_col, least, parts)
    found = found.groupBy("id", "h").agg(F.array_sort(F.collect_set(F.struct("no", "class_id", "n_links", "removed"))).alias("found")).select(F.col("id").alias("id2"), F.col("h").alias("h2"), "found")
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long").alias("n_lines"))
    out = own.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")), "left")
    removed = F.transform(F.filter("found", lambda x: x["removed"]), lambda x: x["no"])
    removed = F.coalesce(removed, F.array().cast("array<int>"))
    lines = F.coalesce(F.transform("found", lambda x: F.struct(x["no"].alias("no"), F.lower(F.hex(x["class_id"])).alias("class_id"), x["n_links"].alias("n_links"))), F.array().cast("array<struct<no:int,class_id:string,n_links:bigint>>"))
    return out.select(F.col("id").alias(id_col), "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed_lines"), lines.alias("lines"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with their texts less the lines that ``line_dedup`` removes; ids must differ, and a row without one stays as it is.
    Shuffles the texts."""
    side = removed.select(F.col(id_col).alias("__line_id"), F.col("removed_lines").alias("__line_gone"))
    own = docs.join(side, F.col(id_col) == F.col("__line_id"), "left")
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col("__line_gone"), i)), "\n")
    return own.withColumn(text_col, F.when(F.coalesce(F.size("__line_gone"), F.lit(0)) == 0, F.col(text_col)).otherwise(kept)).select(*docs.columns)
