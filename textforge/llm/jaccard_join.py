"""Operator 6, n-gram Jaccard join in the metric space of shingle sets: regions of pivots, triangle-inequality windows.

Equal sets are one point. Two sets are linked within r = 1 - s of one another. Three steps, all exact:

1. Sieve. Unrelated texts are all at distance 1 from one another, so whole documents as first pivots would part
   nothing. The first pivots are single shingles. In any one order of all shingles a set's window is its first
   n - ceil(s * n) + 1 shingles: two similar sets share one of these, or one would have too many that the other
   lacks. The sieve's order is by hash, those that several points hold among their first shingles last. A point whose
   window then has only shingles of its own has no partner; most points of a corpus end here.
2. Regions. For the points left, the shingles are counted exactly and ordered by that count, so windows hold what is
   rarest. Points that share a shingle of their windows are in one region; a region holds every partner of its points.
3. Cells. A region of more than MOST points is split by document pivots (Voronoi): a point's home is the cell of its
   nearest pivot within REACH, or the rest beyond. By the triangle inequality a point can have partners at home in a
   pivot's cell only if it is within 2r of being nearest to it, and within REACH + r; it is copied to just those
   cells. Points within r of a pivot are linked through it: where the ball's surroundings (to 2r) hold only points of
   the pivot's component, the ball's points need no comparison at all. Cells are split again, in further shuffles,
   until each is bounded; a region that pivots do not make smaller is compared block by block, again in bounded parts.
   Inside a bounded region the same splitting goes on in memory.

Similarities are exact fractions of 64-bit shingle digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textforge.llm import common
from textforge.llm.components import connected_components
from textforge.llm.fingerprint import _LETTER, _powers, blocks, mix

_RNG = np.random.default_rng(6)
_PLACES = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = np.uint64(0x6A09E667F3BCC909)
#: Points and shingles of a region that one task joins, and pivots of a split.
MOST, WEIGHT, PIVOTS = 128, 1 << 19, 24
#: Distance from its pivot up to which a point is at home in a cell. A region is compared block by block where a split
#: would make more than COPIES rows of each point, and after DEPTH splits.
REACH, COPIES, DEPTH = 0.5, 2, 6
#: Shingles that a task sorts at once before they are dealt, and buckets for each partition they are dealt to.
HELD, BUCKETS = 1 << 19, 8
#: Rounding of distances, which are fractions of whole numbers: windows are wider by this, never narrower.
SLACK = 1e-9


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle digests of each text: text numbers (ascending) and digests (ascending in a text)."""
    gap = b"\n"
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    data = np.frombuffer((gap.join(texts) + gap).lower(), dtype=np.uint8)
    powers, inverses = _powers(len(data))
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(solid.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_LETTER[data] * powers)])
    word = mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
    owner = np.searchsorted(np.cumsum(sizes), starts, side="right")
    per_text = np.bincount(owner, minlength=len(texts))
    n = max(0, len(word) - words + 1)
    digests = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        digests += word[k : k + n] * _PLACES[k]
    inside = owner[:n] == owner[words - 1 :] if n else np.zeros(0, dtype=bool)
    own, digests = owner[:n][inside], mix(digests[inside] + np.uint64(words))
    if (few := np.flatnonzero((per_text > 0) & (per_text < words))).size:  # the whole sequence is one shingle
        first = np.concatenate([[0], np.cumsum(per_text)])
        whole = [sum(int(word[first[i] + k]) * int(_PLACES[k]) for k in range(per_text[i])) + int(per_text[i]) & (2**64 - 1) for i in few]
        own, digests = np.concatenate([own, few]), np.concatenate([digests, mix(np.array(whole, dtype=np.uint64))])
    order = np.lexsort((digests, own))
    own, digests = own[order], digests[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (digests[1:] != digests[:-1])
    return own[new], digests[new]


def set_keys(owner: np.ndarray, digests: np.ndarray, texts: int) -> np.ndarray:
    """A 64-bit digest of each text's set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(digests ^ _SALT))])
    ends = np.searchsorted(owner, np.arange(texts), side="right")
    starts = np.searchsorted(owner, np.arange(texts), side="left")
    return mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64)).view(np.int64)

def window(n: np.ndarray, percent: int) -> np.ndarray:
    """Among how many first shingles of a set of n two sets as similar as percent must share one."""
    return n - -(-percent * n // 100) + 1


def sieve_length(n: np.ndarray, percent: int) -> np.ndarray:
    """How many first shingles of a set of n the sieve sees: its window and some to take the place of shared ones."""
    return np.minimum(n, (13 * window(n, percent) + 9) // 10 + 4)


def _summaries(words: int, percent: int):
    """doc_id, mark, set key, number of shingles, the first shingles by hash, and how many of these are beyond the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                owner, digests = shingle_sets(texts[a:b], words)
                n = np.bincount(owner, minlength=b - a)
                rank = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                length = np.where(n > 0, sieve_length(n, percent), 0)
                spare = np.where(n > 0, length - window(n, percent), 0)
                heads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(digests[rank < np.repeat(length, n)].view(np.int64)))
                columns = [ids.slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(set_keys(owner, digests, b - a)), pa.array(n.astype(np.int64)), pa.array(spare.astype(np.int32)), heads]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "node", "n_shingles", "spare", "heads"])

    return run


def _sets(words: int):
    """(node, text) to (node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in blocks(texts):
                owner, digests = shingle_sets(texts[a:b], words)
                limits = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(limits), pa.array(digests.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), sets], names=["node", "shingles"])

    return run


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The shingles of each row as unsigned numbers."""
    values, offsets = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def intersections(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections, sets by pivots."""
    known = np.unique(np.concatenate(pivots))
    member = np.zeros((len(known), len(pivots)), dtype=np.uint8)
    for k, p in enumerate(pivots):
        member[np.searchsorted(known, p), k] = 1
    out = np.zeros((len(sets), len(pivots)), dtype=np.int64)
    for i, s in enumerate(sets):
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        out[i] = member[at[known[at] == s]].sum(axis=0, dtype=np.int64)
    return out


class Placed:
    """Where the points of a region belong, by their distances from its pivots."""

    def __init__(self, both: np.ndarray, sizes: np.ndarray, pivot_sizes: np.ndarray, percent: int):
        union = sizes[:, None] + pivot_sizes[None, :] - both
        radius, pivots = 1 - percent / 100, both.shape[1]
        far = 1 - both / union
        nearest = far.argmin(axis=1)
        least = far[np.arange(len(far)), nearest]
        #: Within r and within 2r of each pivot, exactly and with slack.
        self.ball = 100 * both >= percent * union
        self.shell = (far <= 2 * radius + SLACK) & ~self.ball
        #: The home of each point (the last number is the rest) and the cells whose windows it lies in.
        self.cell = np.where(least <= REACH, nearest, pivots)
        near = (far <= least[:, None] + 2 * radius + SLACK) & (far <= REACH + radius + SLACK)
        self.windows = np.concatenate([near, (least > REACH - radius - SLACK)[:, None]], axis=1)


def joined_balls(edges: Iterator[tuple[int, int]], pivots: int) -> list[int]:
    """The component of each pivot, where an edge joins two pivots with a common point in their balls."""
    label = list(range(pivots))
    for a, b in edges:
        if (x := label[a]) != (y := label[b]):
            low, high = min(x, y), max(x, y)
            label = [low if v == high else v for v in label]
    return label


def link_region(sets: list[np.ndarray], percent: int) -> list[int]:
    """The component (an index of its first member) of each set, by cells of pivots in cells of pivots."""
    parent = list(range(len(sets)))
    sizes = np.array([len(s) for s in sets], dtype=np.int64)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)

    def compare(own: np.ndarray, pivots: np.ndarray) -> Placed:
        placed = Placed(intersections([sets[i] for i in own], [sets[p] for p in pivots]), sizes[own], sizes[pivots], percent)
        for i, k in zip(*np.nonzero(placed.ball), strict=True):
            link(int(own[i]), int(pivots[k]))
        return placed

    def split(own: np.ndarray, home: np.ndarray) -> None:
        if home.sum() <= PIVOTS:  # all at home are pivots: another split would be this one again
            compare(own, own[home])
            return
        pivots = own[home][:: max(1, int(home.sum()) // PIVOTS)][:PIVOTS]
        placed = compare(own, pivots)
        roots, pivot_roots = np.array([find(int(i)) for i in own]), np.array([find(int(p)) for p in pivots])
        is_open = (placed.shell & (roots[:, None] != pivot_roots[None, :])).any(axis=0)
        left = ~(placed.ball & ~is_open).any(axis=1)
        if placed.windows[left].sum() > COPIES * len(own):  # these pivots part nothing
            at_home = own[home & left]
            for at in range(0, len(at_home), PIVOTS):
                compare(own[left], at_home[at : at + PIVOTS])
            return
        for k in range(len(pivots) + 1):
            inside = left & placed.windows[:, k]
            at_home = (home & (placed.cell == k))[inside]
            if at_home.any() and inside.sum() > 1:
                split(own[inside], at_home)

    if len(sets) > 1:
        split(np.arange(len(sets)), np.ones(len(sets), dtype=bool))
    return [find(i) for i in range(len(sets))]


def _linked(percent: int):
    """Rows (region, node, shingles) come sorted by region; gives (node, root) for the points linked with others."""

    def flush(held: dict[int, np.ndarray]) -> pa.RecordBatch:
        nodes = sorted(held)
        found = link_region([held[x] for x in nodes], percent)
        pairs = [(x, nodes[c]) for x, c in zip(nodes, found, strict=True) if x != nodes[c]]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, held = None, {}
        for batch in batches:
            for own, node, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _lists(batch.column(2)), strict=True):
                if own != region and held:
                    yield flush(held)
                region = own
                held[node] = shingles.copy()
        if held:
            yield flush(held)

    return run


_CELLS = "region long, node long, n int, home boolean, cell int, windows array<int>, balls array<int>, shells array<int>, links array<long>, edges array<int>"


def _placed(percent: int):
    """Rows (region, salt, slot, node, n, home, shingles) come sorted, pivots (slot 0 and up) before points (slot 99)."""

    def answer(region: int, pivots: list[tuple[int, np.ndarray]], rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(r[3]) for r in rows], dtype=np.int64)
        placed = Placed(intersections([r[3] for r in rows], [p[1] for p in pivots]), sizes, np.array([len(p[1]) for p in pivots], dtype=np.int64), percent)
        own = [[np.flatnonzero(x).tolist() for x in m] for m in (placed.windows, placed.ball, placed.shell)]
        links = [[pivots[k][0] for k in b] for b in own[1]]
        edges = [[b[0] * 256 + k for k in b[1:]] for b in own[1]]
        columns = [[region] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], placed.cell.tolist(), *own, links, edges]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.int64()), pa.list_(pa.int32())]
        names = [c.split()[0] for c in _CELLS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pivots, rows, size = None, [], [], 0
        for batch in batches:
            regions, salts, slots, nodes, counts, homes = (batch.column(k).to_pylist() for k in range(6))
            for region, salt, slot, node, n, home, shingles in zip(regions, salts, slots, nodes, counts, homes, _lists(batch.column(6)), strict=True):
                if (region, salt) != part or size > WEIGHT:
                    if rows:
                        yield answer(part[0], pivots, rows)
                    rows, size = [], 0
                    if (region, salt) != part:
                        part, pivots = (region, salt), []
                if slot < 99:
                    pivots.append((node, shingles.copy()))
                else:
                    rows.append((node, n, home, shingles.copy()))
                    size += n
        if rows:
            yield answer(part[0], pivots, rows)

    return run


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = [joined_balls([divmod(e, 256) for e in edges], PIVOTS) for edges in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.list_(pa.int32()))], names=["region", "labels"])


_DEALT = pa.schema([("bucket", pa.int32()), ("pivots", pa.binary()), ("nodes", pa.binary()), ("many", pa.binary())])


def _pairs(pivots: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs, pivot by pivot, and where a pivot begins."""
    order = np.lexsort((nodes, pivots))
    pivots, nodes = pivots[order], nodes[order]
    new = np.ones(len(pivots), dtype=bool)
    new[1:] = (pivots[1:] != pivots[:-1]) | (nodes[1:] != nodes[:-1])
    pivots, nodes = pivots[new], nodes[new]
    first = np.ones(len(pivots), dtype=bool)
    first[1:] = pivots[1:] != pivots[:-1]
    return pivots, nodes, first


def _deal(buckets: int):
    """(node, pivots) to rows of a bucket: its pivots, their nodes and whether a pivot is known to have many.

    A pivot with several nodes in one task is dealt once, marked 1, so a pivot of very many nodes stays few rows;
    its pairs go along as settled, marked 2, dealt by node.
    """
    place = lambda x: ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        pivots, nodes, first = _pairs(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        held.clear()
        several = np.zeros(len(first), dtype=bool)
        several[:-1] = ~first[1:]
        several |= ~first
        marks = np.where(several, 2, 0).astype(np.uint8)
        dealt = [np.concatenate([x, y[first & several]]) for x, y in ((pivots, pivots), (nodes, nodes))]
        marks = np.concatenate([marks, np.ones(int((first & several).sum()), dtype=np.uint8)])
        own = place(np.where(marks == 2, dealt[1].view(np.uint64), dealt[0]))
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        parts = [np.split(x[order], cuts) for x in (dealt[0], dealt[1], marks)]
        columns = [pa.array([[x.tobytes() for x in p] for p in parts][k], pa.binary()) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(own[order][np.concatenate([[0], cuts])]), *columns], schema=_DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy().view(np.uint64)[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
            held.append((values, np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))))
            size += len(values)
            if size > HELD:
                yield flush(held)
                size = 0
        if size:
            yield flush(held)

    return run


def _shared(counts: bool):
    """Rows of _deal, bucket by bucket, to (node, pivot) for pivots of two or more nodes, or to (node, times) with counts."""

    def flush(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        pivots, nodes, marks = (np.frombuffer(b"".join(h[k] for h in held), dtype=t) for k, t in enumerate((np.uint64, np.int64, np.uint8)))
        held.clear()
        known = np.unique(pivots[marks == 1])
        one = marks == 0
        own, node, first = _pairs(pivots[one], nodes[one])
        many = np.zeros(len(own), dtype=bool)
        many[:-1] = ~first[1:]
        many |= ~first
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            many |= known[at] == own
        node, own = np.concatenate([node[many], nodes[marks == 2]]), np.concatenate([own[many], pivots[marks == 2]])
        if counts:
            node, times = np.unique(node, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(times.astype(np.int64))], names=["node", "times"])
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(own.view(np.int64))], names=["node", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != bucket and held:
                    yield flush(held)
                bucket = own
                held.append(tuple(row))
        if held:
            yield flush(held)

    return run


def shared_pivots(lists: DataFrame, counts: bool) -> DataFrame:
    """(node, pivot) for the pivots of lists (node, pivots) that two or more nodes have, or with counts (node, times).

    The pairs are dealt in binary blocks by the pivot's bucket, which costs a fraction of a row for each.
    """
    n = common.partitions(lists.sparkSession)
    dealt = lists.mapInArrow(common.task(_deal(BUCKETS * n)), "bucket int, pivots binary, nodes binary, many binary")
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(common.task(_shared(counts)), "node long, times long" if counts else "node long, pivot long")


def sieved(points: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of classes (node, spare, ...) that may have a partner; from points (node, n_shingles, heads).

    Copies of one text may count a shingle more than once, which keeps a point too many, never one too few.
    """
    met = shared_pivots(points.where("n_shingles > 0").select("node", "heads"), counts=True)
    return classes.join(met.groupBy("node").agg(F.sum("times").alias("shared")), "node").where("shared > spare").drop("shared")


def regions(sets: DataFrame, percent: int, count: int) -> DataFrame:
    """(region, node, n) from count sets (node, shingles): all partners of a node are in its region."""
    held = shared_pivots(sets.select("node", "shingles"), counts=False)
    times = held.groupBy("pivot").agg(F.count("*").alias("times"))
    # a set's shared shingles, rarest first: bounded by its text
    shared = held.join(times, "pivot").groupBy("node").agg(F.array_sort(F.collect_set(F.struct("times", "pivot"))).alias("shared"))
    shared = shared.join(sets.select("node", F.size("shingles").alias("n")), "node")
    least = F.expr(f"cast(({percent} * n + 99) div 100 as int)")
    pivots = shared.withColumn("room", F.size("shared") - least + 1).where("room > 0").select("node", "n", F.explode(F.expr("slice(shared, 1, room)")).alias("s"))
    windows = common.saved(pivots.select("node", "n", F.col("s.pivot").alias("pivot")), "windows", 32 * count)
    centres = windows.groupBy("pivot").agg(F.min("node").alias("b"))
    links = windows.join(centres, "pivot").where("node <> b").select(F.col("node").alias("a"), "b")
    roots = connected_components(links, windows.count())
    members = roots.join(windows.groupBy("node").agg(F.max("n").alias("n")), "node").select(F.col("root").alias("region"), "node", "n")
    return common.saved(members, "regions", windows.select("node").distinct().count())


def region_links(members: DataFrame, sets: DataFrame, percent: int, most: int = MOST, weight: int = WEIGHT) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs inside the regions of members (region, node, n)."""
    n = common.partitions(members.sparkSession)
    pending = members.select("region", "node", "n", F.lit(True).alias("home"))
    links, bounded, depth = [], [], 0
    while True:
        sizes = pending.groupBy("region").agg(F.count("*").alias("points"), F.sum("n").alias("weight"), F.max("home").alias("homes"))
        sizes = common.held(sizes.where("homes and points > 1").select("region", "points", "weight", ((F.col("points") <= most) & (F.col("weight") <= weight)).alias("fits")))
        bounded.append(pending.join(sizes.where("fits").select("region"), "region").select("region", "node"))
        large = sizes.where("not fits").drop("fits")
        if large.isEmpty():
            break
        if depth == DEPTH:
            bounded.append(_blocks(pending.join(large, "region"), most, weight))
            break
        points = large.agg(F.sum("points")).first()[0]
        split, dense, cells = _split(pending.join(large, "region"), sets, percent, most, weight, depth, n, points)
        links.append(cells.select(F.col("node").alias("a"), F.explode("links").alias("b")))
        bounded.append(_blocks(dense, most, weight))
        pending, depth = common.saved(split, "cells", COPIES * points), depth + 1
    own = bounded[0]
    for more in bounded[1:]:
        own = own.unionAll(more)
    dealt = own.join(sets, "node").select("region", "node", "shingles").repartition(n, "region").sortWithinPartitions("region", "node")
    out = dealt.mapInArrow(common.task(_linked(percent)), "a long, b long")
    for more in links:
        out = out.unionAll(more)
    return out.where("a <> b")


def _salts(most: int, weight: int) -> Column:
    """Into how many bounded parts a region of so many points and shingles goes."""
    return F.greatest(F.ceil(F.col("points") / most), F.ceil(F.col("weight") / weight)).cast("int")


def _blocks(rows: DataFrame, most: int, weight: int) -> DataFrame:
    """Regions of two blocks each, of about half the bounds, that together hold each pair of a region."""
    blocks_ = rows.select("region", "node", (2 * _salts(most, weight)).alias("of"))
    own = blocks_.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    pairs = own.select("region", "node", "own", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    return pairs.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other"), F.lit("blocks")).alias("region"), "node")


def _split(rows: DataFrame, sets: DataFrame, percent: int, most: int, weight: int, depth: int, n: int, count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One Voronoi step for count rows (region, node, n, home, points, weight): the rows of cells, those of regions that
    pivots do not part (region, node, points, weight), and what was found of each point."""
    rows = rows.withColumn("salts", _salts(most, weight))
    order = Window.partitionBy("region").orderBy(F.xxhash64("node", F.lit(depth)), "node")
    first = rows.where("home").withColumn("slot", F.row_number().over(order) - 1).where(F.col("slot") < PIVOTS)
    pivots = first.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "slot", "node", "n", "home")
    points = rows.select("region", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(99).alias("slot"), "node", "n", "home")
    dealt = pivots.unionAll(points).join(sets, "node").select("region", "salt", "slot", "node", "n", "home", "shingles")
    dealt = dealt.repartition(n, "region", "salt").sortWithinPartitions("region", "salt", "slot", "node")
    cells, _ = common.mapped(dealt, _placed(percent), _CELLS, "voronoi")
    edges = cells.select("region", F.explode("edges").alias("edge")).groupBy("region").agg(F.collect_set("edge").alias("edges"))  # at most PIVOTS squared
    labels = edges.mapInArrow(_labels, "region long, labels array<int>")
    each = F.sequence(F.lit(0), F.lit(PIVOTS - 1))
    known = cells.join(labels, "region", "left").withColumn("labels", F.coalesce("labels", each))
    known = known.withColumn("mine", F.when(F.size("balls") > 0, F.expr("labels[balls[0]]")).otherwise(-1))
    strange = known.select("region", F.explode(F.expr("filter(shells, k -> labels[k] <> mine)")).alias("k"))
    is_open = strange.groupBy("region").agg(F.collect_set("k").alias("open"))  # at most PIVOTS
    left = known.join(is_open, "region", "left").where(F.size(F.array_except("balls", F.coalesce("open", F.array().cast("array<int>")))) == 0)
    left = common.saved(left.select("region", "node", "n", "home", "cell", "windows"), "unresolved", count)
    sizes = left.groupBy("region").agg(F.count("*").alias("points"), F.sum("n").alias("weight"), (F.sum(F.size("windows")) > COPIES * F.count("*")).alias("dense"))
    left = left.join(sizes, "region")
    inside = left.where("not dense").select("region", "node", "n", "home", "cell", F.explode("windows").alias("k"))
    split = inside.select(F.xxhash64("region", "k", F.lit(depth)).alias("region"), "node", "n", (F.col("home") & (F.col("cell") == F.col("k"))).alias("home"))
    return split, left.where("dense").select("region", "node", "points", "weight"), cells


def jaccard_components(df: DataFrame, words: int = 4, percent: int = 85, keyed: bool = False, most: int = MOST) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of df.

    Words are runs of characters other than ASCII white space, A to Z in lower case; texts with fewer words than a
    shingle have one; null, empty and blank texts have none and are linked with nothing. Two sets are linked if
    100 * intersection >= percent * union (percent 50 or more). component_id is the least doc_id of the component;
    a null doc_id counts as the lowest number. Repeated rows belong together. An empty table gives no rows. Only
    doc_id and text are read, so other columns may have any name. With keyed, the row's common.row_key comes too, and
    part, a number of the component's own (two components have one component_id if their least doc_id is repeated).
    most bounds the points that one task joins; it changes the work, never the result.
    """
    common.prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of(df).cast("binary").alias("text"), *common.row_key(df))
    schema = "doc_id long, mark long, node long, n_shingles long, spare int, heads array<long>"
    points, n_points = common.mapped(rows.select("doc_id", "text", "mark"), _summaries(words, percent), schema, "points")
    own = F.coalesce("doc_id", F.lit(-(2**63))).alias("id")
    classes = points.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct(own, "mark")).alias("least"), F.max("spare").alias("spare"))
    classes = common.saved(classes.select("node", "least.id", "least.mark", "spare"), "classes", n_points)
    few = common.saved(sieved(points, classes), "sieved", n_points)
    common.drop_shuffles(df.sparkSession)
    texts = common.thinned(rows.select("id", "mark", "text"), few, "mark").join(few.select("id", "mark", "node"), ["id", "mark"]).dropDuplicates(["id", "mark"])
    sets, n_sets = common.mapped(texts.select("node", "text"), _sets(words), "node long, shingles array<long>", "sets")
    members = regions(sets, percent, n_sets)
    common.drop_shuffles(df.sparkSession)
    linked = connected_components(region_links(members, sets, percent, most), members.count())
    held = classes.join(linked, "node", "left").select("node", "id", F.coalesce("root", "node").alias("part"))
    lows = held.groupBy("part").agg(F.min("id").alias("low"))
    found = held.join(lows, "part").select("node", "part", "low")
    lowest = F.col("low") == -(2**63)
    key = [own, "mark", "part"] if keyed else []
    return points.select("doc_id", "mark", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(found, "node", "left").select(
        "doc_id", "n_shingles", F.when(lowest, F.lit(None)).otherwise(F.coalesce("low", "doc_id")).cast("long").alias("component_id"), *key
    )


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(common.documents(spark, sf_dir), words=4, percent=85)
