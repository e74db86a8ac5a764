"""Exact top-k search, ranked lexical search and phrase mining against brute force, with all odd cases."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import collocations, exact_topk, lexical_search

CLASHING = ["row", "rank", "score", "dims", "shard", "block", "v", "asks", "term", "terms", "df", "chunk", "h", "n", "f", "w", "words", "goes_on"]


def clashing(df):
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


# --- Exact top-k ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def top_by_brute_force(rows, k):
    kept = [(i, v, [math.floor(256 * x) for x in vec]) for i, (v, vec) in enumerate(rows) if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    out = []
    for i, v, q in kept:
        if v is not None and v % 50 == 0:
            sums = [(max(min(sum(a * b for a, b in zip(q, c)), 2**63 - 1), -(2**63)), w) for j, w, c in kept if j != i and len(c) == len(q)]
            scored = [(-s, w is None, w or 0, w) for s, w in sums]
            out += [(v, n + 1, w, -s) for n, (s, _, _, w) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(map(str, out))


def searched(spark, rows, **options):
    df = clashing(spark.createDataFrame(rows, VECTORS))
    return sorted(str(tuple(r)) for r in exact_topk.top_k(df, F.col("vec_id") % 50 == 0, **options).collect())


def test_top_k_is_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.004, -0.01, 0.5, 1.0]) for _ in range(4)]) for i in range(230)]
    rows += [rows[50], rows[50], (None, rows[100][1]), (None, rows[7][1]), (100, [0.0] * 4), (150, [0.25] * 4)]
    rows += [(300 + i, v) for i, v in enumerate([None, [], [None, 1.0, 1.0, 1.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]])]
    rows += [(350, []), (400, [3.0, -1.0]), (450, [1.0, 1.0, 1.0])]
    want = top_by_brute_force(rows, 5)
    assert searched(spark, rows) == want
    assert searched(spark, rows, shard_rows=17, query_rows=2) == want
    assert searched(spark, rows, k=1, shard_rows=60) == top_by_brute_force(rows, 1)
    assert searched(spark, []) == []
    assert searched(spark, [(50, [1.0])]) == []


@pytest.mark.parametrize("size", [1e4, 1e7, 1e12])
def test_large_components_are_summed_exactly(spark, size):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-size, size) for _ in range(3)]) for i in range(120)]
    assert searched(spark, rows, shard_rows=50) == top_by_brute_force(rows, 5)


def test_lists_are_left_before_their_end():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    rows = np.floor(256 * (base[rng.integers(0, 40, 4000)] * rng.uniform(0.1, 1, (4000, 1)) + 0.01 * rng.normal(size=(4000, 16))))
    lists, scored = exact_topk.SortedLists(rows), []
    for query in rows[:50]:
        at, scores, many = lists.best(query, 5)
        order = np.lexsort((np.arange(4000), -(rows @ query)))[:5]
        assert at.tolist() == order.tolist() and scores.tolist() == (rows @ query)[order].tolist()
        scored.append(many)
    assert np.mean(scored) < 0.7 * len(rows)


# --- Lexical search ------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked_by_brute_force(docs, items, k):
    bags = [(d, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    count, total = len(bags), sum(b.total() for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        terms, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for d, b in bags:
            m = 10 + 90 * b.total() * count // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in terms if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, n + 1, d, -s) for n, (s, _, _, d) in enumerate(sorted(scored, key=lambda r: r[:3])[:k])]
    return sorted(map(str, out))


def ranked(spark, docs, items, *, k=10, build=None, **options):
    index = lexical_search.build_index(clashing(spark.createDataFrame(docs, "doc_id long, text string")).repartition(3), **(build or {}))
    queries = clashing(spark.createDataFrame(items, "item_id long, text string"))
    return sorted(str(tuple(r)) for r in lexical_search.search(index, queries, k=k, **options).collect())


def test_ranking_is_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "漢字", "x1", "É"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([1, 3, 10, 60, 300])))) for i in range(400)]
    docs += [docs[3], docs[3], (None, docs[5][1]), (None, None), (7, None), (900, ""), (901, " .,;-- "), (902, "W1 w1-W1.w2\x00w3"), (903, "w0 " * 20_000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 9)))) for i in range(30)]
    items += [items[0], (None, "w1 w2"), (50, None), (51, ""), (52, "unknown words"), (53, "w1 W1 w1"), (54, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 É 漢字")]
    want = ranked_by_brute_force(docs, items, 10)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, build={"shard_docs": 30}, shards_per_task=3, queries_per_task=7) == want
    assert ranked(spark, docs, items, k=2, build={"shard_bytes": 2000}) == ranked_by_brute_force(docs, items, 2)
    assert ranked(spark, docs, []) == ranked(spark, [], items) == ranked(spark, [(1, None)], items) == []


def test_numbers_survive_packing():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 1 << 21, (1 << 28) - 1, 1 << 31] * 3)
    data, at = lexical_search.packed(values)
    assert lexical_search.unpacked(data).tolist() == values.tolist() and at[-1] == len(data)
    assert lexical_search.unpacked(data[at[4] : at[9]]).tolist() == values[4:9].tolist()


def test_a_skyline_has_the_block_maximum_of_any_collection():
    rng = np.random.default_rng(3)
    block, tf, length = np.sort(rng.integers(0, 20, 900)), rng.integers(1, 30, 900), rng.integers(1, 500, 900)
    best = lexical_search.skyline(block, tf, length)
    assert len(best) < 300 and (np.diff(block[best]) >= 0).all()
    for slope in (0, 1, 9, 5000):
        gain = lexical_search.impact(tf, 10 + slope * length)
        for b in range(20):
            assert gain[block == b].max() == gain[best][block[best] == b].max()


def test_blocks_that_cannot_matter_stay_packed(monkeypatch):
    """A rare term decides; most blocks of a frequent one are neither decompressed nor looked at."""
    rng = random.Random(7)
    docs = [(i, " ".join(["often"] * rng.randrange(1, 3) + ["rare"] * (i % 500 == 3) + ["filler"] * rng.randrange(5, 50))) for i in range(8000)]
    batches = list(lexical_search.shard_rows(0, docs))
    ids, lengths = batches[0].column("doc_ids")[0].as_py(), np.array(batches[0].column("lengths")[0].as_py())
    rows = {r["term"]: r for b in batches[1:] for r in b.to_pylist()}
    norm = lambda n: 10 + 90 * n * len(ids) // int(lengths.sum())
    lists = {t: lexical_search.Postings(r["df"], r["head"], r["body"], norm) for t, r in rows.items()}
    best = lexical_search.Best(3)
    monkeypatch.setattr(lexical_search, "WINDOW_DOCS", 1000)
    lexical_search.search_shard([(9000, lists["rare"]), (10, lists["often"])], ids, lengths, best)
    assert len(lists["often"].last) > 60 and len(lists["often"].known) < 20
    every = {i: 9000 * ("rare" in t) + 0 for i, t in docs}
    assert all(every[r[2]] for r in best.rows)


# --- Phrases -------------------------------------------------------------------------------


def phrases_by_brute_force(docs, least, covered, first):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, 5):
                counts[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent, rows = {p: a for p, a in f.items() if len(p) > 1 and a >= least}, []
        for p, a in frequent.items():
            longer = [b for q, b in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for n, (s, a, p, l, r) in enumerate(sorted(rows)[:first]):
            out.append((lang, n + 1, p.decode(), -a, l, r, totals[lang], -s))
    return sorted(map(str, out))


def mined(spark, docs, **options):
    df = clashing(spark.createDataFrame(docs, "lang string, text string"))
    return sorted(str(tuple(r)) for r in collocations.mine(df, **options).collect())


@pytest.mark.parametrize("trigger, bits", [(1, 1 << 28), (3, 1 << 15), (1000, 1 << 28)])
def test_phrases_are_brute_force(spark, monkeypatch, trigger, bits):
    monkeypatch.setattr(collocations, "MOST_BITS", bits)
    rng = random.Random(8)
    words = ["a", "b", "c", "dd", "é", "漢字", "x\x01y", "\x1c", "A", "naïve", " ", "Q"]
    ends = [" ", "  ", "\t", ". ", "\n", ", ", "\x0b", "!?", ";:"]
    docs = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choices(ends, [9, 2, 1, 1, 1, 1, 1, 1, 1])[0] for _ in range(rng.randrange(0, 60)))
        docs.append((rng.choice(["en", "fr", None, "und"]), text))
    docs += [("en", "never ending words " * 700), ("en", None), ("de", "..."), ("en", ""), *[("fr", "one boilerplate line that all share")] * 40]
    docs += [("en", "y" * 5000)] * 3
    want = phrases_by_brute_force(docs, 6, 80, 25)
    assert mined(spark, docs, least=6, first=25, trigger=trigger) == want and len(want) > 60
    assert mined(spark, [], least=1) == mined(spark, [("en", None)], least=1) == []


def test_each_run_of_words_is_in_one_chunk():
    rng = random.Random(9)
    for trigger in (1, 2, 5, 10_000):
        tokens = [rng.choice([b"a", b"b", b"c", b"d", b"."]) for _ in range(500)]
        words = collocations.Words(tokens)
        begin, end, goes_on = collocations.chunk_bounds(words, trigger)
        seen = collections.Counter()
        for a, b, on in zip(begin.tolist(), end.tolist(), goes_on.tolist()):
            assert b"." not in tokens[a:b]
            for i in range(a, b - (collocations.OVERLAP if on else 0)):
                seen.update((i, n) for n in range(1, 5) if i + n <= b)
        want = collections.Counter((i, n) for n in range(1, 5) for i in range(501 - n) if b"." not in tokens[i : i + n])
        assert seen == want
