"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; its embedding is the
vector of their bit counts.  The Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints, so a range join on the embedding within
that distance finds every pair.  The join's grid: the 32 segments form DISTANCE + equal
groups; of two vectors within DISTANCE, at least ``equal`` groups are the same, so each
pair shares a cell of one of the grids that so many groups span.  Within a cell, points
are sorted by their bit count (the Manhattan distance on the line of sums), those within
reach are held against the Manhattan distance of the embeddings, and those within that
are verified exactly.

The number of groups is chosen from the number of points, so that the likeliest cell
stays small; a cell beyond TILE points all the same is cut into tiles, of which each pair
meets in a group of its own.

Equal fingerprints are one point: copies are never paired.  A cell reports no pairs
but a spanning forest of its links, at most one edge for each of its points and few at
any one, and components are found by contracting the edges round by round in tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_SHARE, Scratch, col, join_hot, map_texts, own, ship

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Cells of more points than this are walked breadth first instead of all at once.
DENSE = 512
#: Cells of more points than this are cut into tiles of about so many.
TILE = 16_384
#: Up to so many cut cells their table is broadcast; beyond, it is joined by shuffle.
BROADCAST_CELLS = 200_000
#: Children of a node in a forest of links.
FAN = 64


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Bits that are set in over half the hashes of the word shingles, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_digest
    line = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return int.from_bytes(h(line, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[size - 1 :] - 1).tolist()
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _BLOCK):
        hashes = b"".join([h(line[i:j], SEED) for i, j in zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK])])
        counters = _SPREAD[np.frombuffer(hashes, dtype=np.uint8)].reshape(-1, 8)
        votes += counters.sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


#: A byte's bits, the highest first, as eight counters of a byte each: sums of up to 255 stay apart.
_BLOCK = 255
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(-1).view(np.uint64)


def fingerprints(docs: DataFrame, keep=("doc_id",), text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs[keep]`` with ``fp``, the fingerprint as a long."""

    def make_kernel():
        def kernel(texts):
            made = np.array([fingerprint(t, size) for t in texts], dtype=np.uint64)
            return [pa.array(made.view(np.int64))]

        return kernel

    return map_texts(docs, make_kernel, [("fp", T.LongType(), pa.int64())], keep, text)


# -- links ---------------------------------------------------------------------------


def group_masks(groups: int) -> list[int]:
    """Bits of each group of segments, as unsigned integers."""
    edges = [round(k * 32 / groups) * 2 for k in range(groups + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]


def groups_equal(points: int, distance: int = DISTANCE, tile: int = TILE) -> int:
    """How many groups span a grid: 2 at least, more while random points would put over a
    tile's worth into the likeliest cell (half of all points in each segment)."""
    equal = 2
    while equal < 4 and points / 2.0 ** (32 * equal / (distance + equal)) > tile / 4:
        equal += 1
    return equal


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp):
    """The bit counts of the 32 segments, packed into a long: 0, 1 and 2 are the bit pairs
    00, 01 and 11, so the Manhattan distance of two is the number of bits that differ."""
    every_other = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(every_other), F.shiftrightunsigned(fp, 1).bitwiseAND(every_other)
    return a.bitwiseOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def embed(fp: np.ndarray) -> np.ndarray:
    """As ``embedding``, of an array of unsigned integers."""
    every_other = np.uint64(0x5555555555555555)
    a, b = fp & every_other, fp >> np.uint64(1) & every_other
    return a | b | (a & b) << np.uint64(1)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n points the smallest point that it reaches over the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def _walk(fp: np.ndarray, distance: int) -> np.ndarray:
    """As _forest, of a large cell (though the point named may be any of the component):
    each point meets only those not yet reached whose bit counts are near enough."""
    count = np.bitwise_count(fp).astype(np.int16)
    order = np.argsort(count, kind="stable")
    fp, count = fp[order], count[order]
    e = embed(fp)
    label = np.arange(len(fp))
    left = np.ones(len(fp), dtype=bool)
    rest, reach, gone = np.arange(len(fp)), count, 0
    for seed in range(len(fp)):
        if not left[seed]:
            continue
        left[seed] = False
        stack, gone = [seed], gone + 1
        while stack:
            at = stack.pop()
            if 2 * gone > len(rest) + 32:
                rest = rest[left[rest]]
                reach, gone = count[rest], 0
            lo, hi = np.searchsorted(reach, count[at] - distance), np.searchsorted(reach, count[at] + distance, side="right")
            some = rest[lo:hi]
            near = some[np.bitwise_count(e[some] ^ e[at]) <= distance]
            near = near[np.bitwise_count(fp[near] ^ fp[at]) <= distance]
            near = near[left[near]]
            left[near] = False
            label[near] = seed
            gone += len(near)
            stack.extend(near.tolist())
    out = np.empty(len(fp), dtype=np.int64)
    out[order] = order[label]
    return out


def _tree(label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the points of each label: trees in which a node has at most FAN
    children, so none becomes the meeting point of all."""
    order = np.argsort(label, kind="stable")
    named = label[order]
    start = np.flatnonzero(np.concatenate(([True], named[1:] != named[:-1])))
    first = np.repeat(start, np.diff(np.append(start, len(named))))
    rank = np.arange(len(named)) - first
    child = np.flatnonzero(rank > 0)
    return order[child], order[first[child] + (rank[child] - 1) // FAN]


def cell_edges(group: np.ndarray, fp: np.ndarray, distance: int, dense: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the forests of links within each group (numbers in ascending order; within
    a group, points in ascending order of bit count)."""
    n = len(fp)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, n))
    of = np.repeat(np.arange(len(start)), size)
    label = np.arange(n)
    count, e = np.bitwise_count(fp).astype(np.int16), embed(fp)
    act, found, k = np.flatnonzero(size[of] <= dense), [], 1
    while len(act):
        act = act[act + k < n]
        act = act[of[act] == of[act + k]]
        # sorted by bit count: beyond the distance once, beyond it for good
        act = act[count[act + k] - count[act] <= distance]
        near = act[np.bitwise_count(e[act] ^ e[act + k]) <= distance]
        near = near[np.bitwise_count(fp[near] ^ fp[near + k]) <= distance]
        if len(near):
            found.append((near, near + k))
        k += 1
    if found:
        label = _forest(n, *(np.concatenate(x) for x in zip(*found)))
    for s, w in zip(start[size > dense], size[size > dense]):
        label[s : s + w] = s + _walk(fp[s : s + w], distance)
    return _tree(label)


def _cells(distance: int, dense: int):
    def join(batches):
        """Rows (t, cell, i, j, fp) sorted by all but fp and then bit count: edges of each group's forest."""
        held: list = []  # pieces of groups that may go on

        def edges(pieces):
            columns = [np.concatenate(x) for x in zip(*pieces)]
            changes = np.zeros(len(columns[0]), dtype=bool)
            for c in columns[:4]:
                changes[1:] |= c[1:] != c[:-1]
            fp = columns[4].view(np.uint64)
            u, v = cell_edges(np.cumsum(changes), fp, distance, dense)
            return pa.RecordBatch.from_arrays([pa.array(fp[u].view(np.int64)), pa.array(fp[v].view(np.int64))], names=["u", "v"])

        for b in batches:
            got = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(got[0]):
                continue
            last = [c[-1] for c in got[:4]]
            other = np.flatnonzero(np.logical_or.reduce([c != x for c, x in zip(got[:4], last)]))
            if len(other):  # a group ended
                cut = other[-1] + 1
                yield edges([*held, [c[:cut] for c in got]])
                held, got = [], [c[cut:] for c in got]
            elif held and any(h[-1] != x for h, x in zip(held[-1][:4], last)):
                yield edges(held)
                held = []
            held.append(got)
        if held:
            yield edges(held)

    return join


def link_forest(points: DataFrame, scratch: Scratch, distance: int = DISTANCE, equal: int | None = None, dense: int = DENSE, tile: int = TILE) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints ``points.fp`` that connect exactly
    those that a chain of links (``distance`` differing bits or fewer) connects.

    equal: groups of segments that span a grid (by default chosen from the number of
    points).  dense: the most points of a cell that are compared all at once.  tile: the
    points that a cell may have before it is cut.  None changes what is connected.
    """
    ship(points.sparkSession)
    count = points.count()
    equal = groups_equal(count, distance, tile) if equal is None else equal
    grids = [_signed(sum(some)) for some in combinations(group_masks(distance + equal), equal)]
    e = embedding(F.col("fp"))
    cells = F.array(*[F.struct(F.lit(t).cast("byte").alias("t"), e.bitwiseAND(F.lit(m)).alias("cell")) for t, m in enumerate(grids)])
    rows = points.select("fp", F.explode(cells).alias("c")).select("c.t", "c.cell", "fp")
    large = scratch.save(rows.groupBy("t", "cell").count().filter(F.col("count") > tile), "large-cells", rows=len(grids) * count // tile)
    many = large.count()
    if not many:
        rows = rows.select("t", "cell", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        tiles = large.select("t", "cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
        rows = rows.join(F.broadcast(tiles) if many <= BROADCAST_CELLS else tiles, ["t", "cell"], "left")
        mine = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
        rows = rows.select("t", "cell", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1)).alias("other"))
        rows = rows.select("t", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    key = ["t", "cell", "i", "j"]
    sorted_ = rows.repartition(*key).sortWithinPartitions(*key, F.bit_count("fp"))
    return sorted_.mapInArrow(_cells(distance, dense), "u bigint, v bigint")


# -- components ----------------------------------------------------------------------


def components(edges: DataFrame, scratch: Scratch, most: int | None = None) -> DataFrame:
    """(node, root) of all nodes of ``edges`` (u, v); nodes have the same root if connected.
    most: about how many nodes there are at most, where it is known.

    Each round every node points to the first of itself and its neighbours in an order
    that changes with the round, the pointers are followed once more, and the edges are
    drawn anew between what they point to.  The rows shrink by a constant factor a
    round at least in expectation, whatever the shape of the components.
    """
    e = scratch.save(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges", rows=most)
    maps, turn = [], 0
    while n := e.count():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        order = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, t=turn: F.xxhash64(F.lit(t), F.col(c)))
        first = both.groupBy("u").agg(F.min(F.struct(order("v").alias("o"), F.col("v").alias("x"))).alias("m"))
        own = F.struct(order("u").alias("o"), F.col("u").alias("x"))
        hop = scratch.save(first.select("u", F.least(F.col("m"), own)["x"].alias("p")), f"hop-{turn}", rows=2 * n)
        again = hop.select(F.col("u").alias("p"), F.col("p").alias("q"))
        step = scratch.save(hop.join(again, "p").select("u", F.col("q").alias("p")), f"step-{turn}", rows=2 * n)
        left = step.select("u", F.col("p").alias("a"))
        right = step.select(F.col("u").alias("v"), F.col("p").alias("b"))
        drawn = e.join(left, "u").join(right, "v").filter("a <> b")
        e = scratch.save(drawn.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), f"edges-{turn}", rows=n)
        maps.append(step)
        turn += 1
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # from the last round back: where many nodes share a pointer, tables are small
    made = maps[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for step in reversed(maps[:-1]):
        made = step.join(made.withColumnRenamed("node", "p"), "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
        made = scratch.save(made, "map", rows=most)
    return made


def near_duplicates(docs: DataFrame, scratch: Scratch, keep=("doc_id",), text: str = "text", distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """``docs[keep]`` with fp, root and component_id of each row of ``docs``.

    root names the component; component_id is the smallest doc_id that links reach (null
    only if all its ids are null).  Null, empty and blank texts have fingerprint zero and
    are linked like any other; texts of fewer words than a shingle are one shingle.
    Repeated rows fall into one component.  An empty table gives an empty result;
    columns besides ``keep`` and the text are not read.  ``keep`` must not hold fp, root
    or component_id.
    """
    marked = scratch.save(fingerprints(docs, keep, text, size), "fingerprints")
    rows = marked.count()
    points = scratch.save(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "points", rows=rows)
    most = points.count()
    rooted = scratch.save(components(link_forest(points.select("fp"), scratch, distance), scratch, most), "roots", rows=most)
    linked = scratch.save(points.join(rooted, points["fp"] == rooted["node"]).select("fp", "root", "least", "n"), "linked", rows=most)
    least = scratch.save(linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("points")), "least", rows=most)
    # one component may hold most points, and one fingerprint most rows
    wide = least.filter(F.col("points") >= max(2, linked.count() / HOT_SHARE)).drop("points")
    named = join_hot(linked.select("fp", "root", "n"), least.drop("points"), "root", wide)
    alone = points.join(linked.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), "n", F.col("least").alias("component_id"))
    class_of = scratch.save(named.unionByName(alone), "classes", rows=most)
    hot = class_of.filter(F.col("n") >= max(2, rows / HOT_SHARE)).drop("n")
    return join_hot(marked, class_of.drop("n"), "fp", hot).select(*[col(c) for c in keep], "fp", "root", "component_id")


def op5(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of each row; cases as in ``near_duplicates``."""
    made = near_duplicates(docs, Scratch(docs.sparkSession, "simhash"))
    return made.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id (rows without an id come last;
    of several rows with that id, one), with all columns of ``docs``, whatever their names.

    Rows are told apart by doc_id and a hash of the text.  Texts are shuffled once, if
    what goes is too much to be broadcast, and those of repeated rows a second time.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    version = F.xxhash64(F.coalesce(col("text").cast("string"), F.lit("")))
    rows = docs.select(col("doc_id"), col("text"), version.alias("version"))
    found = near_duplicates(rows, scratch, ("doc_id", "version"))
    i, v = own("__id__", docs), own("__version__", docs)
    seen = found.groupBy("root", F.col("doc_id").alias(i), F.col("version").alias(v)).agg(F.count("*").alias("n"))
    seen = scratch.save(seen, "seen", rows=(many := docs.count()))
    first = F.min(F.struct(F.col(i).isNull().alias("none"), i, v)).alias("m")
    chosen = seen.groupBy("root").agg(first).select(F.col(f"m.{i}").alias(i), F.col(f"m.{v}").alias(v), F.lit(True).alias("stays"))
    same = [F.col(f"seen.{c}").eqNullSafe(F.col(f"chosen.{c}")) for c in (i, v)]
    judged = seen.alias("seen").join(chosen.alias("chosen"), same[0] & same[1], "left")
    judged = scratch.save(judged.select(f"seen.{i}", f"seen.{v}", "n", F.coalesce("stays", F.lit(False)).alias("stays")), "judged", rows=many)
    is_row = col("doc_id").eqNullSafe(F.col(i)) & (version == F.col(v))
    kept = docs.join(judged.filter("not stays or n > 1").select(i, v), is_row, "left_anti")
    repeated = judged.filter("stays and n > 1").select(i, v)
    if repeated.isEmpty():
        return kept
    once = docs.join(repeated, is_row).dropDuplicates([i, v]).select(*[col(c) for c in docs.columns])
    return kept.unionByName(once)
