"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowloom.llm import fingerprints, ngram_rules, packing, piece_dropout, resampling, secret_scan, token_counts, token_store, url_rules, vp_dedup
from flowloom.llm.tokens import vocabulary
from flowloom.session import scratch_folder

LONG = "word " * 30_000 + "x" * 3_000
ROWS = [
    (1, "the cat sat on the mat and the dog ran over the hill to the far side of the wide river again and again", "a"),
    (1, "the cat sat on the mat and the dog ran over the hill to the far side of the wide river again and again", "a"),
    (2, None, "a"),
    (3, "", None),
    (4, "   \n \t ", "b"),
    (None, "no id here but a text with several plain words in it for all to read and none to lose at any time ok", "b"),
    (5, LONG, "c"),
    (6, "one", "c"),
    (7, "  two  spaces <|endoftext|> and naïve 漢字 🙂 text\n \n", "c"),
]
CLASHING = ["n_words", "kept", "text_key", "part", "point", "view", "key", "bucket", "_words", "_at", "row", "ids", "sequence_id", "items"]
SCHEMA = "doc_id long, text string, source string"
BYTES, WORDS, PIECES = (vocabulary(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("extra") for c in CLASHING})


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 1), (6, 1, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")


def stored(df):
    folder = scratch_folder(df.sparkSession, "edge-store")
    token_store.write_store(df, WORDS, folder)
    return token_store.read_store(df.sparkSession, folder)


PER_ROW = {
    "dropout": lambda d, _: piece_dropout.encode(d, PIECES),
    "counts": lambda d, _: token_counts.count_tokens(d, BYTES),
    "dedup": lambda d, _: vp_dedup.near_duplicates(d),
    "rules": lambda d, labels: ngram_rules.judge(d, labels),
    "secrets": lambda d, _: secret_scan.scan(d),
    "resampling": lambda d, labels: resampling.score(d, resampling.fit(d, labels)),
    "fingerprints": lambda d, _: fingerprints.fingerprint_report(d),
    "store": lambda d, _: stored(d),
    "urls": lambda d, _: url_rules.judge(d, id_col="doc_id", url_col="text"),
}


@pytest.mark.parametrize("name", PER_ROW)
def test_one_row_for_each_row(spark, labels, name):
    rows = PER_ROW[name](docs(spark), labels).collect()
    key = "page_id" if name == "urls" else "doc_id"
    assert sorted(str(r[key]) for r in rows) == sorted(str(r[0]) for r in ROWS)
    twins = [r for r in rows if r[key] == 1]
    varying = {"start", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "next_high", "next_low"}
    assert len({tuple(v for k, v in r.asDict().items() if k not in varying) for r in twins}) == 1


@pytest.mark.parametrize("name", PER_ROW)
def test_empty_table(spark, labels, name):
    assert PER_ROW[name](docs(spark, []), labels.limit(0)).collect() == []


def test_rules_without_labels_leave_the_base_rules(spark, labels):
    for row in ngram_rules.judge(docs(spark), labels.limit(0)).collect():
        assert row.kept == (not row.base_failed)
    kept = ngram_rules.keep(docs(spark), labels.limit(0))
    assert kept.columns == docs(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]


def test_resampling_without_labels_keeps_all(spark, labels):
    model = resampling.fit(docs(spark), labels.limit(0))
    kept = resampling.select(docs(spark), model)
    assert kept.count() == len(ROWS) and kept.columns == docs(spark).columns


def test_packing_places_every_piece_once(spark):
    rows = packing.pack(docs(spark), BYTES, with_ids=True).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows if r.doc_id in (2, 3)) == 2
    assert packing.pack(docs(spark, []), BYTES).collect() == []


def test_dedup_of_a_stage_keeps_one_of_each_group(spark):
    kept = vp_dedup.keep_one(docs(spark))
    assert kept.columns == docs(spark).columns
    # Texts without words are one group.
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "5", "6", "7", "None"]
    assert vp_dedup.keep_one(docs(spark, [])).collect() == []


def test_redaction_keeps_rows_and_null_texts(spark):
    df = docs(spark, [*ROWS, (8, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "c")])
    rows = {(r.doc_id, r.text) for r in secret_scan.redact(df).collect()}
    assert (2, None) in rows and (8, 'x [secret]" y') in rows and len(rows) == len(ROWS)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
