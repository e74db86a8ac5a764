"""Short fingerprints of the near-dedup stage: the search by blocks of bits, and which nodes are searched again."""

import numpy as np
import pytest

from flowloom.llm import vp_dedup


def near(points, radius):
    return np.bitwise_count(points[:, None] ^ points[None, :]) <= radius


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_blocks_find_the_pairs_of_all(radius, monkeypatch):
    rng = np.random.default_rng(radius)
    points = rng.integers(0, 1 << 32, 4000).astype(np.uint32)
    flips = np.uint32(1) << rng.integers(0, 32, (3, 600)).astype(np.uint32)
    points[1000:1600] = points[:600] ^ flips[0] ^ flips[1] ^ flips[2]
    points[2000:2700] = points[7]
    homes, others = (np.flatnonzero(rng.random(4000) < share) for share in (0.8, 0.6))
    compared, whole = [], vp_dedup.close_parts

    def counted(points, h, o, *rest):
        compared.append(len(h) * len(o))
        return whole(points, h, o, *rest)

    monkeypatch.setattr(vp_dedup, "close_parts", counted)
    found = [np.stack(p, 1) for p in vp_dedup.short_parts(points, homes, others, radius, 32)]
    found = np.concatenate(found)
    wanted = np.argwhere(near(points, radius)[np.ix_(homes, others)])
    wanted = {(a, b) for a, b in zip(homes[wanted[:, 0]].tolist(), others[wanted[:, 1]].tolist()) if a != b}
    assert len(found) == len(wanted) and set(map(tuple, found.tolist())) == wanted
    # Apart from the 700 equal points, few pairs share a block.
    assert sum(compared) < 4 * 700 * 700 + 4000 * 4000 / 10


def test_pairs_that_are_not_listed_name_both_ends(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 32, 40)
    rows = []
    for node in range(700):
        # Some 17 nodes around each centre; the last 100 share a point.
        point = int(centres[node % 40]) ^ (1 << int(rng.integers(32))) if node < 600 else int(centres[0])
        sketch = np.zeros(vp_dedup.SKETCH_BITS // 8, np.uint8)
        sketch[rng.integers(0, len(sketch), node % 9 * 5)] ^= 255
        rows.append((0, point, node, sketch.tobytes()))
    rows += [(0, int(p), 700 + i, bytes(32)) for i, p in enumerate(rng.integers(0, 1 << 32, 300))]
    points = spark.createDataFrame(rows, "view int, point long, node long, sketch binary")
    pts, sketches = np.array([r[1] for r in rows], np.uint64), np.array([np.frombuffer(r[3], np.uint64) for r in rows])
    for leaf_points in (1 << 19, 100):
        found = {tuple(r) for r in vp_dedup.candidate_links(points, 2, 56, leaf_points=leaf_points).collect()}
        named = {a for a, b in found if a == b}
        apart = np.bitwise_count(sketches[:, None, :] ^ sketches[None, :, :]).sum(2)
        for a, b in np.argwhere(np.triu(near(pts, 2) & (apart <= 56), 1)).tolist():
            assert (a, b) in found or {a, b} <= named
        assert not any(a < b and not (near(pts[[a, b]], 2).all() and apart[a, b] <= 56) for a, b in found)
        # Nodes without a neighbour are not searched again.
        assert len(named & set(range(700, 1000))) < 10
