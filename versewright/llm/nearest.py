"""Approximate nearest neighbours by an inverted multi-index.

Unit vectors are cut into halves and each half is quantised by a codebook of its own;
a vector's cell is the pair of its centroids.  A query walks the pairs in ascending
order of summed distance (a heap over the two sorted lists of centroids) until their
cells hold the wanted number of rows, and what the cells hold is reranked by the exact
cosine of the original vectors.

The codebooks grow with the square root of the rows, so cells stay small.  The number of
rows that a query visits is no share set by hand: it is read off a bounded number of
probe rows, whose true neighbours one scan finds, as the number that holds the TARGET
share of them.  Vectors with clusters so need few candidates; those without any (the
test data) need about a third of all.

Cells are dealt to blocks of a fixed number of rows, large cells to several.  A query is
sent to the blocks of its cells only; a block that very many queries walk into is copied
for chunks of them, as many as its own queries fill.  Vectors of different lengths have
codebooks, cells and blocks of their own.
"""

from __future__ import annotations

from heapq import heappop, heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, ship

#: Centroids for each half: GROWTH times the square root of the rows, at most so many.
GROWTH, MAX_CENTROIDS = 1.25, 1_024
#: Expected number of vectors that the codebooks are fitted on, at most, and their bytes.
MAX_TRAINING, MAX_TRAINING_BYTES = 16_384, 64 << 20
ROUNDS = 12
#: Rows of each vector length whose true neighbours tell how many candidates hold the
#: TARGET share of them.
PROBES, TARGET = 256, 0.95
BLOCK_ROWS, CHUNK_QUERIES = 4_096, 2_048
NEIGHBOURS = 5


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) without null ids and without vectors that are null, zero or hold null
    or non-finite components."""
    rows = vectors.select(col(key).cast("bigint").alias("vec_id"), col(vector).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay
    what they are to the last bit."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, keepdims=True))
    return np.ldexp(x, -exponent)


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array):
    """(positions, matrix) of the rows of each length."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        whole = len(at) == len(lengths)
        yield at, flat.reshape(-1, n) if whole else flat[(ends[at] - n)[:, None] + np.arange(n)]


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] - 2 * x @ centroids.T + (centroids * centroids).sum(axis=1)[None, :]


def codebook(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Lloyd's algorithm from k rows of x; empty clusters start anew at the farthest rows."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        d = _distances(x, centroids)
        nearest = d.argmin(axis=1)
        order = np.argsort(nearest, kind="stable")
        starts = np.searchsorted(nearest[order], np.arange(len(centroids)))
        size = np.diff(np.append(starts, len(x)))
        far = iter(np.argsort(-d.min(axis=1), kind="stable").tolist())
        for j in range(len(centroids)):
            centroids[j] = x[order[starts[j] : starts[j] + size[j]]].mean(axis=0) if size[j] else x[next(far)]
    return centroids


def walk(near: np.ndarray, far: np.ndarray, counts: list[int], wanted: int) -> list[int]:
    """Cells in ascending order of summed distance until they hold ``wanted`` rows.

    The heap has one entry for each centroid of the first half that is open, its next
    pair: a whole number, the distance in units of 2**-32 above the centroid's rank."""
    a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
    bits = len(a).bit_length()
    whole = lambda d: (np.maximum(d, 0) * 2.0**32).astype(np.int64) << bits
    rows, far = (whole(near[a]) + np.arange(len(a))).tolist(), [*whole(far[b]).tolist(), None]
    start, b, mask = (a * len(b)).tolist(), b.tolist(), (1 << bits) - 1
    at, heap, cells, held, opened = [0] * len(rows), [rows[0] + far[0]], [], 0, 1
    while held < wanted and heap:
        i = heap[0] & mask
        j = at[i]
        cell = start[i] + b[j]
        cells.append(cell)
        held += counts[cell]
        at[i] = j + 1
        after = far[j + 1]
        if after is None:
            heappop(heap)
        else:
            heapreplace(heap, rows[i] + after)
        if not j and opened < len(rows):
            heappush(heap, rows[opened] + far[0])
            opened += 1
    return cells


def lay_out(counts: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell: small cells share a block."""
    first, parts = np.zeros(len(counts), dtype=np.int32), np.ones(len(counts), dtype=np.int32)
    block, held = 0, 0
    for at in np.flatnonzero(counts).tolist():
        n = int(counts[at])
        if held and held + n > rows:
            block, held = block + 1, 0
        first[at], parts[at] = block, -(-n // rows)
        if n > rows:
            block, held = block + int(parts[at]), 0
        else:
            held += n
    return first, parts


class Books:
    """The codebooks of all vector lengths; cells are numbered through, length by length."""

    def __init__(self, lengths: dict[int, int], sample: dict[int, np.ndarray], centroids: int = MAX_CENTROIDS):
        self.of, self.cells = {}, 0
        for n, rows in sorted(lengths.items()):
            units, half = _unit(sample[n]) if n in sample else np.zeros((1, n)), max(1, n // 2)
            k = max(1, min(centroids, int(np.ceil(GROWTH * np.sqrt(rows))), len(units)))
            left = codebook(units[:, :half], k)
            right = codebook(units[:, half:], k) if n > half else np.zeros((1, 0))
            self.of[n] = (half, left, right, self.cells)
            self.cells += len(left) * len(right)

    def span(self, n: int) -> slice:
        _, left, right, start = self.of[n]
        return slice(start, start + len(left) * len(right))

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half, left, right, _ = self.of[units.shape[1]]
        return _distances(units[:, :half], left), _distances(units[:, half:], right)

    def cell(self, x: np.ndarray) -> np.ndarray:
        near, far = self.distances(_unit(x))
        return self.of[x.shape[1]][3] + near.argmin(axis=1) * far.shape[1] + far.argmin(axis=1)


def _shares(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each id, by its bits."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) / 2.0**64


def _best(qid, q, visits, vid, x, k):
    """Of each query the k nearest of the rows that it visits: exact, ties to the smaller
    id.  visits: for each query, which of the rows."""
    q, x = _scaled(q), _scaled(x)
    qn, xn = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    rough = (q / qn[:, None]) @ (x / xn[:, None]).T
    rough[~visits] = -np.inf
    rough[qid[:, None] == vid[None, :]] = -np.inf
    of, ids, scores = [], [], []
    for i in range(len(qid)):
        row = rough[i]
        take = np.flatnonzero(row > -np.inf)
        if len(take) > k:
            least = np.partition(row[take], len(take) - k)[len(take) - k]
            take = take[row[take] >= least - 1e-9]
        # summed row by row, so equal vectors have equal scores
        score = (x[take] * q[i]).sum(axis=1) / (xn[take] * qn[i])
        order = np.lexsort((vid[take], -score))[:k]
        of.append(np.full(len(order), i))
        ids.append(vid[take][order])
        scores.append(score[order])
    return of, ids, scores


def _distinct(vid, x, *more):
    """Without repeated rows of one id and vector."""
    if len(np.unique(vid)) < len(vid):
        once = np.unique(np.column_stack([vid.view(np.float64), x]).view(np.uint64), axis=0, return_index=True)[1]
        return vid[once], x[once], *(m[once] for m in more)
    return vid, x, *more


def needed(index: DataFrame, books, counts: np.ndarray, k: int, probes: int = PROBES, target: float = TARGET) -> dict[int, int]:
    """For each vector length the rows to visit: as many as hold the target share of the
    true neighbours of its probes (expected ``probes`` rows, those of small hashes).  One
    scan compares them with all rows; each task reports k rows for each probe."""
    spark = index.sparkSession
    limits = spark.sparkContext.broadcast({n: min(1.0, probes / max(1, int(counts[books.span(n)].sum()))) for n in books.of})

    def pick(batches):
        for b in batches:
            share = _shares(b.column(0).to_numpy(zero_copy_only=False), 1)
            stay = [at[share[at] < limits.value[x.shape[1]]] for at, x in _by_length(b.column(1))]
            yield b.take(pa.array(np.sort(np.concatenate([*stay, np.zeros(0, dtype=np.int64)]))))

    chosen = index.select("vec_id", "v").mapInArrow(pick, "vec_id bigint, v array<double>").toArrow()
    asked = {}
    if len(chosen):
        ids = chosen["vec_id"].to_numpy()
        for at, x in _by_length(chosen["v"].combine_chunks()):
            asked[x.shape[1]] = (at, ids[at], x)
    shared = spark.sparkContext.broadcast(asked)

    def compare(batches):
        best: dict = {}
        for b in batches:
            ids, cells = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for at, x in _by_length(b.column(1)):
                if x.shape[1] not in shared.value:
                    continue
                number, qid, q = shared.value[x.shape[1]]
                vid, some, cell = _distinct(ids[at], x, cells[at])
                of, got, scores = _best(qid, q, np.ones((len(qid), len(vid)), dtype=bool), vid, some, k)
                where = dict(zip(vid.tolist(), cell.tolist()))
                for i, g, s in zip(number.tolist(), got, scores):
                    rows = best.setdefault(i, [])
                    rows += [(-x, y, where[y]) for x, y in zip(s.tolist(), g.tolist())]
                    best[i] = sorted(set(rows))[:k]
        made = [(i, -s, v, c) for i, rows in best.items() for s, v, c in rows]
        columns = list(zip(*made)) or [(), (), (), ()]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["probe", "score", "vec_id", "cell"])

    found = index.select("vec_id", "v", "cell").mapInArrow(compare, "probe bigint, score double, vec_id bigint, cell int").distinct()
    true = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id")
    cells: dict = {}
    for r in found.withColumn("r", F.row_number().over(true)).filter(F.col("r") <= k).select("probe", "cell").collect():
        cells.setdefault(r["probe"], []).append(r["cell"])
    out = {}
    for n in books.of:
        held = counts[books.span(n)]
        number, _, x = asked.get(n, ((), None, None))
        rows = []
        for at, i in enumerate(number):
            near, far = books.distances(_unit(x[at : at + 1]))
            total = (near[0][:, None] + far[0][None, :]).ravel()
            rows += [int(held[total <= total[c - books.of[n][3]]].sum()) for c in cells.get(int(i), ())]
        out[n] = int(np.quantile(rows, target, method="higher")) if rows else int(held.sum())
    return out


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, visit: float | None = None, centroids: int = MAX_CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score, n_visited): the k nearest found of each row for which
    the condition ``is_query`` on vec_id holds, among all rows with another id and as many
    components, by cosine.  n_visited: rows in the cells that the query walked.

    visit: share of the rows to visit; by default as many as hold TARGET of the true
    neighbours of the probes.  Fewer than k candidates: all of them.  Ties go to the
    smaller id.  Repeated rows of one id and vector count once; of several vectors with
    one id the nearest counts.  Vectors that are null, zero or hold null or non-finite
    components take no part; an empty table gives an empty result; other columns are not
    read.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "nearest")
    rows = usable(vectors, key, vector)
    lengths = {r["n"]: r["count"] for r in rows.groupBy(F.size("v").alias("n")).count().collect()}
    total = sum(lengths.values())
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double, n_visited bigint")
    bound = min(MAX_TRAINING, max(1, MAX_TRAINING_BYTES // (8 * max(lengths))))
    hashed = F.xxhash64("vec_id", F.lit("sample")).bitwiseAND(F.lit((1 << 32) - 1))
    sample = rows if total <= bound else rows.filter(hashed < F.lit(int(bound / total * (1 << 32))))
    fitted = sample.select("v").toArrow()["v"].combine_chunks()
    books_ = Books(lengths, {x.shape[1]: x for _, x in _by_length(fitted)} if len(fitted) else {}, centroids)
    books = spark.sparkContext.broadcast(books_)

    def assign(batches):
        for b in batches:
            cell = np.zeros(b.num_rows, dtype=np.int32)
            for at, x in _by_length(b.column(1)):
                cell[at] = books.value.cell(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], names=["vec_id", "v", "cell"])

    index = scratch.save(rows.mapInArrow(assign, "vec_id bigint, v array<double>, cell int"), "index")
    counts = np.zeros(books_.cells, dtype=np.int64)
    counted = index.groupBy("cell").count().toArrow()  # a row for each cell at most
    counts[counted["cell"].to_numpy()] = counted["count"].to_numpy()
    if visit is None:
        wanted = needed(index, books_, counts, k)
    else:
        wanted = {n: int(np.ceil(visit * rows)) for n, rows in lengths.items()}
    wanted = {n: max(w, min(lengths[n], k + 1)) for n, w in wanted.items()}
    first, parts = lay_out(counts)
    plan = spark.sparkContext.broadcast((counts, first, parts, wanted))

    def route(batches):
        counts, first, parts, wanted = plan.value
        held = {n: counts[books.value.span(n)].tolist() for n in wanted}
        for b in batches:
            for at, x in _by_length(b.column(1)):
                n = x.shape[1]
                start = books.value.of[n][3]
                near, far = books.value.distances(_unit(x))
                made, size = [], 0
                for i in range(len(at)):
                    cells = start + np.array(walk(near[i], far[i], held[n], wanted[n]))
                    cells = np.sort(cells[counts[cells] > 0])
                    visited = counts[cells].sum()
                    # a large cell's blocks follow each other
                    part = np.arange(parts[cells].sum()) - np.repeat(np.cumsum(parts[cells]) - parts[cells], parts[cells])
                    met = np.repeat(first[cells], parts[cells]) + part
                    cells = np.repeat(cells, parts[cells])
                    cut = np.flatnonzero(np.concatenate(([True], met[1:] != met[:-1])))
                    made.append((met[cut], np.full(len(cut), at[i]), np.diff(np.append(cut, len(met))), cells, np.full(len(cut), visited)))
                    size += len(cut)
                    if size >= 8192:
                        yield _routed(b, *map(np.concatenate, zip(*made)))
                        made, size = [], 0
                if made:
                    yield _routed(b, *map(np.concatenate, zip(*made)))

    def _routed(b, met, of, size, cells, visited):
        offsets = pa.array(np.concatenate(([0], np.cumsum(size))), type=pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(cells, type=pa.int32()))
        columns = [pa.array(met, type=pa.int32()), b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), lists, pa.array(visited, type=pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["block", "query_id", "q", "cells", "n_visited"])

    def place(batches):
        _, first, parts, _ = plan.value
        for b in batches:
            cell = b.column(2).to_numpy(zero_copy_only=False)
            part = (_shares(b.column(0).to_numpy(zero_copy_only=False), 2) * parts[cell]).astype(np.int32)
            yield b.append_column("block", pa.array(first[cell] + part, type=pa.int32()))

    queries = rows.filter(is_query(F.col("vec_id")))
    routed = scratch.save(queries.mapInArrow(route, "block int, query_id bigint, q array<double>, cells array<int>, n_visited bigint"), "routed")
    chunks = routed.groupBy("block").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("chunks"))
    asking = routed.join(chunks, "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")
    placed = index.mapInArrow(place, "vec_id bigint, v array<double>, cell int, block int").join(chunks, "block")
    placed = placed.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")

    def meet(xs: pa.Table, qs: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        for at, x in _by_length(xs["v"].combine_chunks()) if xs.num_rows and qs.num_rows else ():
            vid, x, cell = _distinct(xs["vec_id"].to_numpy()[at], x, xs["cell"].to_numpy()[at])
            here, cell = np.unique(cell, return_inverse=True)
            for low in range(0, qs.num_rows, 256):
                some = qs.slice(low, 256).combine_chunks()
                lists = some["cells"].combine_chunks()
                walked = lists.flatten().to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(some.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                place = np.minimum(np.searchsorted(here, walked), len(here) - 1)
                found = here[place] == walked  # a block may hold cells of other vector lengths
                visits = np.zeros((some.num_rows, len(here)), dtype=bool)
                visits[of[found], place[found]] = True
                for mine, q in _by_length(some["q"].combine_chunks()):
                    if q.shape[1] == x.shape[1]:
                        qid, seen = some["query_id"].to_numpy()[mine], some["n_visited"].to_numpy()[mine]
                        got, ids, scores = _best(qid, q, visits[mine][:, cell], vid, x, k)
                        for into, values in zip(out, ([qid[g] for g in got], ids, scores, [seen[g] for g in got])):
                            into += values
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, dtype=kind)
        columns = [join(values, kind) for values, kind in zip(out, (np.int64, np.int64, np.float64, np.int64))]
        return pa.table(dict(zip(("query_id", "vec_id", "score", "n_visited"), columns)))

    met = placed.groupBy("block", "chunk").cogroup(asking.groupBy("block", "chunk")).applyInArrow(meet, "query_id bigint, vec_id bigint, score double, n_visited bigint")
    once = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("n_visited").alias("n_visited"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "n_visited")


def op6(vectors: DataFrame) -> DataFrame:
    """The five nearest found of each row whose vec_id is divisible by 50; cases as in ``search``."""
    return search(vectors, lambda i: i % 50 == 0)
