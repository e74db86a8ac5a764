"""SimHash near-dedup by vantage-point trees.

Distinct fingerprints are spread over the leaves of a vantage-point tree: at each node a point
goes to the near or the far side of a sphere around the node's vantage point. Two points within
the radius differ in their distances to it by at most the radius, so a point also visits, as a
guest, each side that its own distance plus or minus the radius reaches. Each linked pair thus
meets in the leaf where one of the two lives. A leaf is searched by a vantage-point tree of its own
and gives back links that span its classes, not all pairs; the classes of all leaves are
joined as connected components. Leaves with many points are cut into blocks of bounded size.

``near_duplicates`` links fingerprints, exactly. ``similar_groups`` and ``keep_one`` group texts by the Jaccard similarity of
their shingles: trees over short fingerprints give candidates, and the exact similarity of these decides.

The outer tree is fitted on a bounded sample of fingerprints: it decides only where points meet.

Cases: a null text is an empty one; texts without words have fingerprint 0 and link like any other;
repeated rows each get a row; a null id gets a fingerprint, and its class id is the smallest id
that is not null, or null if there is none; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.bitmaps import marked
from flowloom.llm.graph import components
from flowloom.llm.inputs import in_slices, task_count, texts, tidied, written

LEAF_POINTS = 16_384
SAMPLE_PER_LEAF = 64
MOST_LEAVES = 1 << 12
BRUTE_POINTS = 512
# Points of a leaf of the stage's short fingerprints: the deeper the tree, the more guests.
STAGE_POINTS = 1 << 19
# Rows of one point that are compared pair by pair.
CROWD = 64
# Links that are compared, and given back, at a time.
PART_LINKS = 1 << 18
# Parts of the space of hashes whose counts of shingles are compared, and how many such rows at a time.
PARITY_BITS = 2048
PART_ROWS = 1 << 14


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``size`` lower-cased words; of all words if there are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < size:
        return np.array([hashed(join(words), 42)], np.uint64)
    runs = zip(*[words[i:] for i in range(size)])
    return np.fromiter((hashed(join(r), 42) for r in runs), np.uint64, len(words) - size + 1)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """1 for each bit (from the highest) that is set in over half of the 64-bit rows; (n, words) gives 64 * words bits."""
    rows = hashes.reshape(len(hashes), -1)
    ones = np.zeros(64 * rows.shape[1], np.int64)
    for begin in range(0, len(rows), 255):
        bits = np.unpackbits(rows[begin : begin + 255].astype(">u8").view(np.uint8), axis=1)
        ones += bits.sum(axis=0, dtype=np.uint8)
    return (2 * ones > len(rows)).astype(np.uint8)


def fingerprint(text: str, size: int = 3) -> int:
    hashes = shingle_hashes(text, size)
    return int.from_bytes(np.packbits(majority_bits(hashes)).tobytes(), "big") if len(hashes) else 0


def fingerprints(docs: DataFrame, *, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``point``, the 64-bit fingerprint as a long, of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            points = np.array([fingerprint(t, size) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(points.view(np.int64))], ["doc_id", "point"])

    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return narrow.mapInArrow(tidied(each), "doc_id long, point long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class VantageTree:
    """A complete binary tree of vantage points and radii, fitted on sample points."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 0) -> None:
        self.depth = depth
        self.points, self.radii = np.zeros(1 << depth, np.uint64), np.zeros(1 << depth, np.int16)
        rng = np.random.default_rng(seed)

        def fit(node: int, own: np.ndarray) -> None:
            if node >= 1 << depth:
                return
            source = own if len(own) else sample
            tried = source[rng.integers(0, len(source), 8)]
            spread = [differing(own, t).std() if len(own) else 0 for t in tried]
            self.points[node] = tried[int(np.argmax(spread))]
            distance = differing(own, self.points[node])
            self.radii[node] = int(np.median(distance)) if len(own) else 32
            near = distance <= self.radii[node]
            fit(2 * node, own[near])
            fit(2 * node + 1, own[~near])

        if depth and len(sample):
            fit(1, sample)

    def assign(self, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, is home) for each leaf a point lives in or visits."""
        row, node, home = np.arange(len(points)), np.ones(len(points), np.int64), np.ones(len(points), bool)
        for _ in range(self.depth):
            distance = differing(points[row], self.points[node])
            at = self.radii[node]
            # A pair across the sphere meets on the near side; so homes of the near side do not visit the far one.
            near_home, far_home = home & (distance <= at), home & (distance > at)
            near_guest, far_guest = ~home & (distance <= at + radius), ~home & (distance > at - radius)
            new_guest = far_home & (distance <= at + radius)
            parts = [(near_home, 0, True), (far_home, 1, True), (near_guest, 0, False), (far_guest, 1, False), (new_guest, 0, False)]
            row, node, home = (np.concatenate(x) for x in zip(*[(row[m], 2 * node[m] + side, np.full(int(m.sum()), is_home)) for m, side, is_home in parts]))
        return row, node - (1 << self.depth), home


class Classes:
    """Classes of positions under links, named by their smallest position."""

    def __init__(self, count: int) -> None:
        self.root = np.arange(count)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            of_a, of_b = self.root[a], self.root[b]
            on = of_a != of_b
            if not on.any():
                return
            a, b, of_a, of_b = a[on], b[on], of_a[on], of_b[on]
            np.minimum.at(self.root, np.maximum(of_a, of_b), np.minimum(of_a, of_b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def close_parts(points: np.ndarray, homes: np.ndarray, others: np.ndarray, radius: int, rng=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of pairs (home, other) within the radius, branch by branch."""
    rng = rng or np.random.default_rng(0)
    if not len(homes) or not len(others):
        return
    if len(homes) > BRUTE_POINTS:
        vantage = points[homes[rng.integers(len(homes))]]
        of_homes, of_others = differing(points[homes], vantage), differing(points[others], vantage)
        at = int(np.median(of_homes))
        if (of_homes > at).all() or (of_homes <= at).all():
            at = int(of_homes.min())
        near = of_homes <= at
        sides = [(homes[near], others[of_others <= at + radius]), (homes[~near], others[of_others > at - radius])]
        # Go on only while the split saves work.
        if sum(len(h) * len(o) for h, o in sides) < 0.95 * len(homes) * len(others):
            for h, o in sides:
                yield from close_parts(points, h, o, radius, rng)
            return
    step = max(1, (1 << 22) // max(1, len(others)))
    for begin in range(0, len(homes), step):
        h = homes[begin : begin + step]
        a, b = np.nonzero(np.bitwise_count(points[h][:, None] ^ points[others][None, :]) <= radius)
        a, b = h[a], others[b]
        yield a[a != b], b[a != b]


def close_pairs(points: np.ndarray, homes: np.ndarray, others: np.ndarray, radius: int, found) -> None:
    """Calls ``found(a, b)`` with the parts of ``close_parts``."""
    for a, b in close_parts(points, homes, others, radius):
        found(a, b)


def short_parts(points: np.ndarray, homes: np.ndarray, others: np.ndarray, radius: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of ``close_parts`` for many points of few ``bits``, where a sphere prunes little.

    Two points within the radius have one of radius + 1 blocks of bits in common. Points are searched among those
    that share a block's value, by a tree where these are many; a pair counts at its first such block.
    """
    rng = np.random.default_rng(0)
    if len(homes) <= BRUTE_POINTS:
        yield from close_parts(points, homes, others, radius, rng)
        return
    bounds = [bits * k // (radius + 1) for k in range(radius + 2)]
    masks = [points.dtype.type((1 << high) - (1 << low)) for low, high in zip(bounds, bounds[1:])]
    held, size = [], 0
    for k, mask in enumerate(masks):
        of_homes, of_others = points[homes] & mask, points[others] & mask
        h, o = homes[np.argsort(of_homes, kind="stable")], others[np.argsort(of_others, kind="stable")]
        of_homes.sort()
        of_others.sort()
        values, begins = np.unique(of_homes, return_index=True)
        low, high = (np.searchsorted(of_others, values, side).tolist() for side in ("left", "right"))
        for begin, end, x, y in zip(begins.tolist(), [*begins[1:].tolist(), len(h)], low, high):
            for a, b in close_parts(points, h[begin:end], o[x:y], radius, rng):
                apart = points[a] ^ points[b]
                fresh = np.ones(len(a), bool)
                for before in masks[:k]:
                    fresh &= (apart & before) != 0
                held.append((a[fresh], b[fresh]))
                size += len(held[-1][0])
                if size >= PART_LINKS:
                    yield tuple(np.concatenate(x) for x in zip(*held))
                    held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def leaf_rows(points: DataFrame, radius: int, *, leaf_points: int = LEAF_POINTS, most_rows: int | None = None) -> DataFrame:
    """Rows (view, leaf, row block, column block, home, point, node[, sketch][, class][, n][, parity]) for the leaf tasks.

    ``points`` is a durable table of (view, point) with the node that stands for it. Leaves with more than ``most_rows``
    (twice ``leaf_points``) are cut.
    """
    spark = points.sparkSession
    sizes = {r["view"]: r["n"] for r in points.groupBy("view").agg(F.count("*").alias("n")).collect()}
    trees = {}
    depth = {v: min(MOST_LEAVES, max(1, n // leaf_points)).bit_length() - 1 for v, n in sizes.items()}
    wanted = {v: SAMPLE_PER_LEAF << d for v, d in depth.items()}
    if any(depth.values()):
        share = F.lit(0)
        for v, n in sizes.items():
            share = F.when(F.col("view") == v, F.lit(int(wanted[v] / n * (1 << 30)))).otherwise(share)
        some = points.where(F.pmod(F.xxhash64("view", "point"), F.lit(1 << 30)) < share).select("view", "point").collect()
    for v, d in depth.items():
        own = np.array([r["point"] for r in some if r["view"] == v], np.int64) if d else np.zeros(0, np.int64)
        trees[v] = VantageTree(own.view(np.uint64), d if len(own) else 0, seed=v)
    trees = spark.sparkContext.broadcast(trees)
    # Leaves above the size are cut: their homes into row blocks, all their points into column blocks.
    kinds = {"point": "long", "node": "long", "sketch": "binary", "class": "long", "n": "int", "parity": "binary"}
    carried = [c for c in kinds if c in points.columns]
    schema = ", ".join(["view int, leaf int, home boolean", *[f"{c} {kinds[c]}" for c in carried]])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views, points_ = batch.column("view").to_numpy(), batch.column("point").to_numpy().view(np.uint64)
            for view in np.unique(views):
                at = np.flatnonzero(views == view)
                row, leaf, home = trees.value[int(view)].assign(points_[at], radius)
                own = batch.take(pa.array(at[row]))
                arrays = [own.column("view"), pa.array(leaf, pa.int32()), pa.array(home)] + [own.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays(arrays, ["view", "leaf", "home", *carried])

    spread_rows = points.mapInArrow(spread, schema)
    counts = spread_rows.groupBy("view", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > (most_rows or 2 * leaf_points))
    blocks = {(r["view"], r["leaf"]): -(-r["n"] // (2 * leaf_points)) for r in counts.collect()}
    known = F.create_map(*[F.lit(x) for (v, leaf), k in blocks.items() for x in (f"{v} {leaf}", k)]) if blocks else None
    many = F.coalesce(known[F.concat_ws(" ", "view", "leaf")], F.lit(1)) if blocks else F.lit(1)
    own = F.pmod(F.xxhash64("point", "node"), many).cast("int")
    every = F.sequence(F.lit(0), many - 1)
    as_home = F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("home"), (j == own).alias("other")))
    as_other = F.transform(F.filter(every, lambda i: ~F.col("home") | (i != own)), lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("home"), F.lit(True).alias("other")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home"), F.lit(True).alias("other")))
    cells = F.when(many == 1, single).when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other) if blocks else single
    return spread_rows.withColumn("cell", F.explode(cells)).select("view", "leaf", "cell.i", "cell.j", "cell.home", "cell.other", *carried)


def links(points: DataFrame, radius: int, *, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """Edges (a, b) between nodes, enough to join all points within ``radius`` into one class."""
    rows = leaf_rows(points, radius, leaf_points=leaf_points)

    def search(key: tuple, group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        spots = group.column("point").to_numpy().view(np.uint64)
        home, other = (np.flatnonzero(group.column(c).to_numpy(zero_copy_only=False)) for c in ("home", "other"))
        classes = Classes(len(node))
        close_pairs(spots, home, other, radius, classes.link)
        moved = np.flatnonzero(classes.root != np.arange(len(node)))
        pairs = np.unique(np.stack([node[moved], node[classes.root[moved]]], 1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    dealt = rows.repartition(task_count(points.sparkSession), "view", "leaf", "i", "j")
    return dealt.groupBy("view", "leaf", "i", "j").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, *, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", leaf_points: int = LEAF_POINTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    prints = written(fingerprints(docs, size=size, id_col=id_col, text_col=text_col), "simhash")
    # A fingerprint is its own node, so rows without an id link and bridge like any other.
    points = written(prints.groupBy("point").agg(F.min("doc_id").alias("least")), "simhash-points")
    nodes = points.select(F.lit(0).alias("view"), "point", F.col("point").alias("node"))
    joined = components(links(nodes, radius, leaf_points=leaf_points), "simhash-links")
    classes = points.join(joined, F.col("point") == F.col("node"), "left").select("point", "least", F.coalesce("component", "point").alias("class"))
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "class").select("point", "component_id")
    found = prints.join(classes, "point")
    return found.select("doc_id", F.lower(F.lpad(F.hex("point"), 16, "0")).alias("fingerprint"), "component_id")


VIEWS = 20
VIEW_BITS = 32
SKETCH_BITS = 256


def signature(text: str, size: int) -> bytes:
    """Majority bits of the shingles under more hashes: ``VIEWS`` short fingerprints, then a sketch."""
    hashes = shingle_hashes(text, size)
    words = (VIEWS * VIEW_BITS + SKETCH_BITS) // 64
    if not len(hashes):
        return bytes(8 * words)
    mixed = hashes[:, None] ^ (np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.packbits(majority_bits(mixed ^ (mixed >> np.uint64(31)))).tobytes()


def sketch_radius(similarity: float) -> int:
    """Differing sketch bits that two texts of this Jaccard similarity stay below nearly always (3 deviations)."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    return int(SKETCH_BITS * share + 3 * np.sqrt(SKETCH_BITS * share * (1 - share)))


def covered(spots: np.ndarray, sketch: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of crowded points that a leader stands for, and their leaders.

    Of a point with more than ``CROWD`` rows the first row leads all whose sketches are within ``bits`` of its own,
    the first of the others leads on, and so forth.
    """
    order = np.argsort(spots, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], spots[order][1:] != spots[order][:-1]])) if len(order) else order
    end = np.append(begin[1:], len(order))
    rows, leaders = [], []
    for a, b in zip(begin[end - begin > CROWD].tolist(), end[end - begin > CROWD].tolist()):
        left = order[a:b]
        while len(left) > 1:
            led = np.bitwise_count(sketch[left[1:]] ^ sketch[left[0]]).sum(1) <= bits
            rows.append(left[1:][led])
            leaders.append(np.full(int(led.sum()), left[0]))
            left = left[1:][~led]
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, leaders))


def candidate_links(points: DataFrame, radius: int, sketch_radius: int, *, leaf_points: int) -> DataFrame:
    """Candidate links (a, b), a < b: of each row of a leaf, its smallest and its nearest neighbour.

    Neighbours are points within ``radius`` whose sketches differ in at most ``sketch_radius`` bits; the nearest
    is that of the closest sketch. Rows of a crowded point that a leader stands for link to it. So a group of
    any size gives a few links a row, not its pairs. A row (a, a) names a node that may have neighbours besides
    those listed: it has more of them, or is near a crowded point. Of a pair that is not listed both nodes are named.
    """

    def search(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("node")
        node, spots = group.column("node").to_numpy(), group.column("point").to_numpy().view(np.uint64)
        home, other = (group.column(c).to_numpy(zero_copy_only=False) for c in ("home", "other"))
        sketch, short = packed(group, "sketch", SKETCH_BITS), spots.astype(np.uint32)
        rows, leaders = covered(spots, sketch, sketch_radius // 3)
        alone = np.ones(len(node), bool)
        alone[rows] = False
        none = 1 << 60
        # Rows are in order of node, so the smallest neighbour has the smallest position.
        smallest, nearest = np.full(len(node), none), np.full(len(node), none)
        count = np.zeros(len(node), np.int64)

        def found(all_a: np.ndarray, all_b: np.ndarray) -> None:
            for begin in range(0, len(all_a), 1 << 18):
                a, b = all_a[begin : begin + (1 << 18)], all_b[begin : begin + (1 << 18)]
                apart = np.bitwise_count(sketch[a] ^ sketch[b]).sum(1, dtype=np.int64)
                on = (apart <= sketch_radius) & (node[a] != node[b])
                a, b, apart = a[on], b[on], apart[on] << 40
                for x, y in ((a, b), (b, a)):
                    np.minimum.at(smallest, x, y)
                    np.minimum.at(nearest, x, apart + y)
                # Two homes meet twice.
                once = (a < b) | ~(home[b] & other[a])
                for x in (a[once], b[once]):
                    np.add.at(count, x, 1)

        for a, b in short_parts(short, np.flatnonzero(home & alone), np.flatnonzero(other & alone), radius, VIEW_BITS):
            found(a, b)
        own = np.flatnonzero(smallest < none)
        more = count > (smallest < none).astype(np.int64) + (smallest != nearest & ((1 << 40) - 1))
        if len(rows):
            crowds = rows[np.unique(spots[rows], return_index=True)[1]]
            more[crowds] = True
            for a, b in short_parts(short, crowds, np.arange(len(node)), radius, VIEW_BITS):
                more[b] = True
        at = np.concatenate([own, own, rows])
        to = np.concatenate([smallest[own], nearest[own] & ((1 << 40) - 1), leaders])
        on = node[at] != node[to]
        low, high = np.minimum(node[at], node[to])[on], np.maximum(node[at], node[to])[on]
        return pa.table({"a": np.concatenate([low, node[more]]), "b": np.concatenate([high, node[more]])})

    rows = leaf_rows(points, radius, leaf_points=leaf_points, most_rows=4 * leaf_points)
    dealt = rows.repartition(task_count(points.sparkSession), "view", "leaf", "i", "j")
    return dealt.groupBy("view", "leaf", "i", "j").applyInArrow(search, "a long, b long").distinct()


def parts(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of entries whose sizes add up to at most ``PART_LINKS``, or of one entry."""
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PART_LINKS, side="right")))
        yield slice(begin, end)
        begin = end


def runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each size, one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def other_pairs(group: pa.Table, radius: int, sketch_radius: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (home row, other row) of all candidates of a leaf whose ends differ in ``class``, in parts of bounded size.

    Rows of one point and class are searched as one, so a large group whose classes are joined already costs little.
    Pairs that ``wanted`` does not name are left out before their sketches are compared.
    """
    own, spots = (group.column(c).to_numpy() for c in ("class", "point"))
    home, other = (group.column(c).to_numpy(zero_copy_only=False) for c in ("home", "other"))
    sketch = packed(group, "sketch", SKETCH_BITS)
    # A unit is the rows of one point and class.
    by_spot, by_class = (np.unique(x, return_inverse=True)[1] for x in (spots, own))
    _, first, unit = np.unique(by_spot * len(own) + by_class, return_index=True, return_inverse=True)
    at, unit_class = spots[first].astype(np.uint32), own[first]
    homes, others = (np.flatnonzero(m)[np.argsort(unit[m], kind="stable")] for m in (home, other))
    bounds = np.arange(len(first) + 1)
    of_homes, of_others = np.searchsorted(unit[homes], bounds), np.searchsorted(unit[others], bounds)

    def expanded(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the home rows of units ``u`` and the other rows of units ``v``, pair by pair of units."""
        wide, high = of_others[v + 1] - of_others[v], of_homes[u + 1] - of_homes[u]
        # A home row of a pair of units is an entry; parts are runs of entries.
        for some in parts(high):
            pair = np.repeat(np.arange(len(u))[some], high[some])
            a = homes[np.repeat(of_homes[u][some], high[some]) + runs(high[some])]
            for part in parts(wide[pair]):
                n = wide[pair[part]]
                x = np.repeat(a[part], n)
                y = others[np.repeat(of_others[v][pair[part]], n) + runs(n)]
                on = wanted(x, y)
                x, y = x[on], y[on]
                on = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= sketch_radius
                yield x[on], y[on]

    for u, v in short_parts(at, np.unique(unit[homes]), np.unique(unit[others]), radius, VIEW_BITS):
        on = unit_class[u] != unit_class[v]
        if on.any():
            yield from expanded(u[on], v[on])


def packed(group: pa.Table, column: str, bits: int) -> np.ndarray:
    """A column of byte strings of one size as rows of 64-bit words."""
    values = group.column(column).combine_chunks()
    values = values.cast(pa.large_binary()) if isinstance(values, pa.Array) else pa.concat_arrays([c.cast(pa.large_binary()) for c in values.chunks])
    begin = np.frombuffer(values.buffers()[1], np.int64)[values.offset] if len(values) else 0
    return np.frombuffer(values.buffers()[2] or b"", np.uint64, len(values) * bits // 64, begin).reshape(len(values), bits // 64)


def by_leaf(points: DataFrame, radius: int, search: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, *, leaf_points: int) -> DataFrame:
    """The distinct rows that ``search`` gives for the leaves of ``points``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(list(batches))
        if len(group):
            yield from search(group)

    rows = leaf_rows(points, radius, leaf_points=leaf_points, most_rows=4 * leaf_points)
    dealt = rows.repartition(task_count(points.sparkSession), "view", "leaf", "i", "j")
    return dealt.groupBy("view", "leaf", "i", "j").applyInArrow(each, schema).distinct()


def open_nodes(points: DataFrame, radius: int, sketch_radius: int, *, leaf_points: int) -> DataFrame:
    """The nodes that have a candidate in another class: a row each, however many candidates there are."""

    def search(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node = group.column("node").to_numpy()
        seen = np.zeros(len(node), bool)
        for x, y in other_pairs(group, radius, sketch_radius, lambda x, y: ~(seen[x] & seen[y])):
            seen[x] = seen[y] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[seen]), pa.int64())], ["node"])

    return by_leaf(points, radius, search, "node long", leaf_points=leaf_points)


def other_candidates(points: DataFrame, radius: int, sketch_radius: int, *, leaf_points: int, similarity: float | None = None) -> DataFrame:
    """All candidate links (a, b), a < b, whose ends differ in ``class``: none is left out, however many there are.

    With a ``similarity`` the points hold ``n`` and ``parity`` of their sets of shingles, and links that these prove to be
    less similar are left out: two sets differ in no fewer elements than their parities in bits.
    Links are given back in parts of bounded size.
    """

    def search(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node = group.column("node").to_numpy()
        if similarity is not None:
            sizes, parity = group.column("n").to_numpy().astype(np.int64), packed(group, "parity", PARITY_BITS)

        def wanted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            if similarity is None:
                return np.ones(len(x), bool)
            return np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])

        for x, y in other_pairs(group, radius, sketch_radius, wanted):
            if similarity is not None:
                apart = np.concatenate([np.bitwise_count(parity[x[i : i + PART_ROWS]] ^ parity[y[i : i + PART_ROWS]]).sum(1, dtype=np.int64) for i in range(0, len(x) or 1, PART_ROWS)])
                # Similar sets differ in at most this share of both sizes; a little more allows for rounding.
                on = apart <= (1 - similarity) / (1 + similarity) * (sizes[x] + sizes[y]) + 1e-6
                x, y = x[on], y[on]
            x, y = node[x], node[y]
            links = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0], pa.int64()), pa.array(links[:, 1], pa.int64())], ["a", "b"])

    return by_leaf(points, radius, search, "a long, b long", leaf_points=leaf_points)


def text_key(text: Column) -> list[Column]:
    """128 bits that tell texts apart; a null text is an empty one."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("key_1"), F.xxhash64(F.lit("second"), whole).alias("key_2")]


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each of ``PARITY_BITS`` parts of the space of hashes: whether it holds an odd number of these."""
    counts = np.bincount((hashes & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits(counts.astype(np.uint8) & 1).tobytes()


def shingle_sets(docs: DataFrame, nodes: DataFrame, ends: DataFrame, size: int) -> DataFrame:
    """(node, n, shingles, parity) of the texts of ``ends`` (node), written.

    ``docs`` is (doc_id, text), ``nodes`` (node, least, key_1, key_2).
    """
    nodes = written(nodes.join(ends, "node"), "similar-ends")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            found = [np.unique(shingle_hashes(t, size)) for t in batch.column("text").to_pylist()]
            counts, parities = pa.array([len(f) for f in found], pa.int32()), pa.array([parity(f) for f in found], pa.binary())
            sets = pa.array([f.view(np.int64) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), counts, sets, parities], ["node", "n", "shingles", "parity"])

    # Only texts of ``nodes``, and few others, are shuffled.
    keyed = marked(docs.select("doc_id", "text", *text_key(F.col("text"))), nodes, nodes.count(), key="key_1", flag="met").where("met").drop("met")
    keyed = keyed.join(nodes, ["key_1", "key_2"])
    # Of copies the one with the smallest id, of repeated rows any: they have one text.
    one = keyed.where(F.col("doc_id").eqNullSafe(F.col("least"))).groupBy("node").agg(F.first("text").alias("text"))
    return written(one.mapInArrow(each, "node long, n int, shingles array<long>, parity binary"), "shingle-sets")


def ends_of(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def verified(candidates: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) whose ``sets`` of shingles are similar enough; texts without words are all alike."""
    both = candidates
    for end in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(end), F.col("n").alias("n_" + end)), end)
    # The smaller set holds no more than all that is shared, the larger no less than the joint one.
    both = both.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")).select("a", "b")
    for end in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(end), F.col("shingles").alias("of_" + end)), end)
    shared = F.size(F.array_intersect("of_a", "of_b"))
    joint = F.size("of_a") + F.size("of_b") - shared
    return written(both.where((joint == 0) | (shared >= similarity * joint)).select("a", "b"), "similar-links")


def between_classes(links: DataFrame, joined: DataFrame) -> DataFrame:
    """The links (a, b) whose ends are in different classes of ``joined`` (node, component)."""
    for end in ("a", "b"):
        own = joined.select(F.col("node").alias(end), F.col("component").alias("of_" + end))
        links = links.join(own, end, "left").withColumn("of_" + end, F.coalesce("of_" + end, end))
    return links.where("of_a <> of_b").select("a", "b")


def similar_texts(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, radius: int = 2, leaf_points: int = STAGE_POINTS) -> DataFrame:
    """(key_1, key_2, class, least, rows) of each distinct text of ``docs`` (doc_id, text).

    At a similarity of 0.8 two 64-bit fingerprints differ in some ten bits, where no sphere prunes. So there are
    ``VIEWS`` independent short fingerprints, each with a vantage-point tree of its own, and two texts are candidates
    if one view is within ``radius`` bits and their sketches agree. Candidates link if the exact Jaccard similarity
    of their sets of shingles is high enough: first each text with its smallest neighbour, then with its nearest and
    its leader, then with every other candidate, each time only where these are not in its class yet. The last ones
    are listed only if sizes and parities of the sets leave open whether they are similar. So no
    candidate is left out: it was compared, or proved to be less similar, or its two texts are in one class.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, "text"):
            signed = pa.array([signature(t, size) for t in batch.column("text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "key_1", "key_2")], signed], ["doc_id", "key_1", "key_2", "signature"])

    def views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, head = batch.num_rows, VIEWS * VIEW_BITS // 8
            raw = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, -1)
            points = np.ascontiguousarray(raw[:, :head]).view(">u4").astype(np.int64)
            sketch = pa.array([s.tobytes() for s in raw[:, head:]], pa.binary())
            own = {"node": batch.column("node"), "sketch": sketch} | {c: batch.column(c) for c in ("class", "n", "parity") if c in batch.schema.names}
            for view in range(VIEWS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, view), pa.int32()), pa.array(points[:, view]), *own.values()], ["view", "point", *own])

    keyed = docs.select("doc_id", "text", *text_key(F.col("text")))
    signed = keyed.mapInArrow(tidied(each), "doc_id long, key_1 long, key_2 long, signature binary")
    nodes = signed.groupBy("key_1", "key_2", "signature").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "signature-nodes")
    signatures, nodes = nodes.select("node", "signature"), nodes.drop("signature")
    points = written(signatures.mapInArrow(views, "view int, point long, node long, sketch binary"), "signature-points")
    found = written(candidate_links(points, radius, sketch_radius(similarity), leaf_points=leaf_points), "similar-candidates")
    # The ends of a candidate that is not listed; the others need not be searched again.
    unlisted, found = found.where("a = b").select(F.col("a").alias("node")), found.where("a <> b")
    first = found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    sure = verified(first, shingle_sets(docs, nodes, ends_of(first), size), similarity)
    joined = components(sure, "similar-classes")
    more = written(between_classes(found.join(first, ["a", "b"], "left_anti"), joined), "similar-others")
    if not more.isEmpty():
        sure = sure.unionByName(verified(more, shingle_sets(docs, nodes, ends_of(more), size), similarity))
        joined = components(sure, "similar-classes")
    classed = signatures.join(unlisted, "node").join(joined, "node", "left").select("node", "signature", F.coalesce("component", "node").alias("class"))
    classed = written(classed, "signature-classes")
    points = written(classed.mapInArrow(views, "view int, point long, node long, sketch binary, class long"), "signature-points")
    left = written(open_nodes(points, radius, sketch_radius(similarity), leaf_points=leaf_points), "similar-open")
    if not left.isEmpty():
        # Only texts with a candidate in another class are compared again, with what their shingles prove about pairs.
        sets = shingle_sets(docs, nodes, left, size)
        points = classed.join(sets.select("node", "n", "parity"), "node")
        points = written(points.mapInArrow(views, "view int, point long, node long, sketch binary, class long, n int, parity binary"), "signature-points")
        rest = other_candidates(points, radius, sketch_radius(similarity), leaf_points=max(1, leaf_points // 8), similarity=similarity)
        rest = written(rest.join(found, ["a", "b"], "left_anti"), "similar-rest")
        if not rest.isEmpty():
            joined = components(sure.unionByName(verified(rest, sets, similarity)), "similar-classes")
    return nodes.join(joined, "node", "left").select("key_1", "key_2", F.coalesce("component", "node").alias("class"), "least", "rows")


def similar_groups(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", leaf_points: int = STAGE_POINTS) -> DataFrame:
    """doc_id and component_id of each row: the smallest id of its group that is not null, or null if there is none."""
    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = written(similar_texts(narrow, size=size, similarity=similarity, radius=radius, leaf_points=leaf_points), "similar-texts")
    named = found.join(found.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("key_1", "key_2", "component_id")
    return narrow.select("doc_id", *text_key(F.col("text"))).join(named, ["key_1", "key_2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", leaf_points: int = STAGE_POINTS) -> DataFrame:
    """The rows of ``docs`` less those of a group's other documents.

    A document is an id and a text, so rows that share an id are told apart. Of a group the document with the
    smallest id stays (an id that is null comes last, then the text's hash decides); rows that repeat
    it, id and text alike, stay with it.
    """
    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = written(similar_texts(narrow, size=size, similarity=similarity, leaf_points=leaf_points), "similar-texts")
    first = F.min(F.struct(F.col("least").isNull().alias("lost"), "least", "key_1", "key_2")).alias("first")
    found = found.join(found.groupBy("class").agg(first, F.sum("rows").alias("of_class")), "class").where("of_class > 1")
    wins = (F.col("key_1") == F.col("first.key_1")) & (F.col("key_2") == F.col("first.key_2"))
    told = written(found.select(F.col("key_1").alias("_vp_1"), F.col("key_2").alias("_vp_2"), wins.alias("_vp_wins"), F.col("least").alias("_vp_least")), "similar-verdicts")
    key_1, key_2 = text_key(F.col(f"`{text_col}`"))
    # The row is carried whole, so no column of it can clash; only rows whose text may be in a group are shuffled.
    held = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), key_1.alias("_vp_1"), key_2.alias("_vp_2"))
    maybe = marked(held, told, told.count(), key="_vp_1", flag="maybe")
    judged = maybe.where("maybe").join(told, ["_vp_1", "_vp_2"], "left")
    stays = F.col("_vp_wins") & F.col("id").eqNullSafe(F.col("_vp_least"))
    kept = judged.where(F.col("_vp_wins").isNull() | stays)
    return kept.select("row.*").union(maybe.where("not maybe").select("row.*"))
