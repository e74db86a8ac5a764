"""Cases of the third review: each would have failed before its change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.llm import ngram_rules, vp_dedup


def test_only_texts_that_may_be_trusted_leave_their_place(spark):
    words = "a plain text of some words that go on and on until there are more than twenty of them in it , number"
    docs = spark.createDataFrame([(d if d % 100 else None, f"{words} {d}") for d in range(4000)], "doc_id long, text string")
    trusted = spark.createDataFrame([(d,) for d in range(1, 4000, 50)], "trusted_id int")
    told = ngram_rules.maybe_trusted(docs, trusted)
    assert told.columns == ["doc_id", "text", "maybe"] and told.count() == 4000
    found = {r.doc_id for r in told.where("maybe").collect()}
    assert found >= set(range(1, 4000, 50)) and len(found) <= 80 + 0.1 * 4000


def test_trusted_counts_are_those_of_a_plain_join(spark):
    rng = np.random.default_rng(1)
    rows = [(int(d) if d % 7 else None, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"], 30)) + f" t{d % 40}") for d in rng.integers(0, 300, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(d, d % 2, 0) for d in range(0, 300, 3)], "doc_id int, quality int, toxic int")
    scores, least = ngram_rules.fit(docs, labels)
    plain = ngram_rules.with_ngrams(docs.join(ngram_rules.trusted_ids(labels), F.col("doc_id") == F.col("trusted_id"), "left"))
    raw, goal = [0] * ngram_rules.BUCKETS, [0] * ngram_rules.BUCKETS
    for r in plain.collect():
        for g in r["_grams"]:
            raw[g] += 1
            goal[g] += r["trusted_id"] is not None
    assert any(goal) and scores == ngram_rules.bucket_scores(raw, goal)
    means = ngram_rules.with_mean_score(plain.where("trusted_id is not null").select("text"), scores)
    cut = means.agg(F.percentile("mean_score", F.lit(ngram_rules.QUANTILE))).first()[0]
    assert least == int(np.floor(cut)) - ngram_rules.SLACK


def crowded_pairs(seed):
    """Pairs of texts just above 0.8, each text among fifty that are just below 0.8 to it."""
    rng = np.random.default_rng(seed)
    words, rows = [f"w{i}" for i in range(3000)], []

    def changed(text, places):
        text = list(text)
        for at in places:
            text[at] = words[int(rng.integers(3000))]
        return text

    for d in range(8):
        one = rng.choice(words, 100).tolist()
        two = changed(one, (20, 70))
        rows += [(1000 * d + 998, " ".join(one)), (1000 * d + 999, " ".join(two))]
        for n in range(100):
            first = int(rng.integers(5, 40))
            rows.append((1000 * d + n, " ".join(changed((one, two)[n % 2], (first, first + int(rng.integers(10, 50)), 99)))))
    return rows


@pytest.mark.parametrize("leaf_points", [64, 1 << 19])
def test_no_candidate_of_a_text_is_left_out(spark, leaf_points):
    rows = crowded_pairs(2)
    found = {r.doc_id: r.component_id for r in vp_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), leaf_points=leaf_points).collect()}
    signed = np.array([np.frombuffer(vp_dedup.signature(t, 5), np.uint8) for _, t in rows])
    sets = [set(vp_dedup.shingle_hashes(t, 5).tolist()) for _, t in rows]
    head, most = vp_dedup.VIEWS * vp_dedup.VIEW_BITS // 8, vp_dedup.sketch_radius(0.8)
    own = {d: d for d, _ in rows}
    pairs = []
    for i in range(len(rows)):
        apart = np.bitwise_count(signed[i] ^ signed)
        views = apart[:, :head].reshape(len(rows), vp_dedup.VIEWS, -1).sum(2)
        for j in np.flatnonzero((views.min(1) <= 2) & (apart[:, head:].sum(1) <= most)):
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                pairs.append((rows[i][0], rows[j][0]))
    while any(own[a] != own[b] for a, b in pairs):
        for a, b in pairs:
            own[a] = own[b] = min(own[a], own[b])
    assert len(pairs) >= 4 and found == own


def test_links_between_classes_are_given_whole(spark):
    """Crowded points, many classes, leaves cut in blocks: all pairs of different classes, none of one class."""
    rng = np.random.default_rng(6)
    spots, own = rng.integers(0, 6, 300) * 7, rng.integers(0, 9, 300)
    sketch = rng.integers(0, 256, (300, vp_dedup.SKETCH_BITS // 8), np.uint8)
    rows = [(0, int(p), i, bytearray(s.tobytes()), int(c)) for i, (p, s, c) in enumerate(zip(spots, sketch, own))]
    points = spark.createDataFrame(rows, "view int, point long, node long, sketch binary, class long")
    apart = np.bitwise_count(sketch[:, None] ^ sketch[None]).sum(2)
    near = np.bitwise_count(spots[:, None] ^ spots[None]) <= 2
    wanted = {(int(a), int(b)) for a, b in zip(*np.nonzero(near & (apart <= 126) & (own[:, None] != own[None]))) if a < b}
    for leaf_points in (20, 1 << 19):
        found = [(r.a, r.b) for r in vp_dedup.other_candidates(points, 2, 126, leaf_points=leaf_points).collect()]
        assert len(found) == len(wanted) > 1000 and set(found) == wanted


def test_kept_rows_with_clashing_columns_stay_as_they_are(spark):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, 5, 6, 7), (2, words, 1, 2, 3), (None, words, 1, 1, 1), (4, "alone", 8, 9, 10), (4, None, 0, 0, 0), (4, None, 0, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, _bucket int, _bits int")
    kept = vp_dedup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], *rows[3:]]))


def test_texts_just_below_the_similarity_are_not_listed_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base, rows = [f"b{i}" for i in range(80)], []
    for d in range(300):
        # One word each: texts changed at one place are alike by 0.87, others by 0.77.
        text, at = list(base), 5 + 5 * (d % 14)
        text[at] = f"own{rng.integers(1 << 40)}"
        rows.append((d, " ".join(text)))
    listed, written = {}, vp_dedup.written

    def counted(df, purpose):
        df = written(df, purpose)
        listed[purpose] = listed.get(purpose, 0) + df.count()
        return df

    monkeypatch.setattr(vp_dedup, "written", counted)
    found = vp_dedup.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {d: d % 14 for d in range(300)}
    assert listed["similar-rest"] <= 4 * len(rows)


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(6)
    for size in (0, 1, 50, 5000):
        one = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
        two = np.unique(np.concatenate([one[: size // 2], rng.integers(0, 1 << 63, size // 3, np.uint64)]))
        bits = [np.frombuffer(vp_dedup.parity(x), np.uint8) for x in (one, two)]
        assert len(bits[0]) * 8 == vp_dedup.PARITY_BITS
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, two))
