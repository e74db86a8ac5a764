"""Readers and writers of packet tables, flow files and datasets."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.functions.hexfmt import from_one_line, on_one_line
from flowloom.operators.checks import stratified_sample
from flowloom.operators.datasets import Datasets, feature_schema, normalize_columns
from flowloom.operators.export import export_rows
from flowloom.schema import PACKET_SCHEMA

# Names of the dataset outputs.
DATASET_NAMES = ("dataset_flow_only", "dataset_flow_plus_ja4", "report_view")
SCHEMA_NAME = "feature_schema"
SAMPLE_NAME = "validation_sample"
MANIFEST = "manifest"
# Names come from the wire and may hold anything; blanks and quotes are kept as they are.
NAME_COLUMN = "ja4_alpn"
EXACT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def read_packets(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.schema(PACKET_SCHEMA).parquet(*paths)


def read_flow_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Raw flow files: every column as text, bound by name; no value is read as missing.

    A row with too many or too few fields is an error. Line breaks in names are written as
    ``\\n`` and ``\\r``, so that files can be split at any line.
    """
    reader = spark.read.options(**EXACT).options(enforceSchema=False, mode="FAILFAST", columnPruning=False)
    raw = normalize_columns(reader.csv(list(paths)))
    if NAME_COLUMN not in raw.columns:
        return raw
    return raw.withColumn(NAME_COLUMN, from_one_line(F.col(NAME_COLUMN)))


def write_flow_csv(flows: DataFrame, path: str, mode: str = "error") -> None:
    # emptyValue: an empty text stays an empty field instead of a pair of quotes.
    rows = export_rows(flows).withColumn(NAME_COLUMN, on_one_line(F.col(NAME_COLUMN)))
    rows.write.mode(mode).options(**EXACT).option("emptyValue", "").csv(path)


def write_datasets(datasets: Datasets, outdir: str, fmt: str = "csv", mode: str = "error") -> None:
    """Three datasets and the description of their columns, each in a folder of its own."""
    spark = datasets.flow_only.sparkSession
    for name, frame in zip(DATASET_NAMES, datasets):
        writer = frame.write.mode(mode)
        if fmt == "csv":
            writer = writer.option("header", True).option("emptyValue", "")
        writer.format(fmt).save(f"{outdir}/{name}")
    text = json.dumps(feature_schema("label" in datasets.flow_only.columns), indent=2)
    described = spark.createDataFrame([(text,)], "value string")
    described.coalesce(1).write.mode(mode).text(f"{outdir}/{SCHEMA_NAME}")


def write_sample(rows: DataFrame, path: str, mode: str = "error") -> None:
    """The validation sample as one small CSV file."""
    sample = stratified_sample(rows).coalesce(1)
    sample.write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def _versions(spark: SparkSession, outdir: str) -> list[dict]:
    """Manifests of all versions that were written to the end, oldest first."""
    try:
        lines = spark.read.text(f"{outdir}/{MANIFEST}/*").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((json.loads(r["value"]) for r in lines), key=lambda m: (m["number"], m["folder"]))


def publish(datasets: Datasets, rows: DataFrame, outdir: str, fmt: str = "parquet") -> str:
    """The three datasets, their description and the sample of ``rows``, as one version that appears as a whole.

    All go to a folder of their own; the manifest, one line, is written last, and readers follow it. A write that stops
    before that shows nothing, and the version before stays the one that is read. Gives the version's folder.
    """
    spark = rows.sparkSession
    folder, known = f"version-{uuid.uuid4().hex}", _versions(spark, outdir)
    write_datasets(datasets, f"{outdir}/{folder}", fmt)
    write_sample(rows, f"{outdir}/{folder}/{SAMPLE_NAME}")
    described = {name: frame.columns for name, frame in zip(DATASET_NAMES, datasets)}
    line = {"number": known[-1]["number"] + 1 if known else 1, "folder": folder, "format": fmt, "columns": described}
    spark.createDataFrame([(json.dumps(line),)], "value string").coalesce(1).write.text(f"{outdir}/{MANIFEST}/{folder}")
    return f"{outdir}/{folder}"


def published(spark: SparkSession, outdir: str) -> dict[str, DataFrame]:
    """Outputs of the newest whole version by name; the description is a table with one ``value``."""
    versions = _versions(spark, outdir)
    if not versions:
        raise FileNotFoundError(f"{outdir} has no version that was written to the end")
    newest = versions[-1]
    folder = f"{outdir}/{newest['folder']}"
    # A CSV file has only names; values are read as they are written.
    reader = spark.read.format(newest["format"]).options(**({"header": True} if newest["format"] == "csv" else {}))
    outputs = {name: reader.load(f"{folder}/{name}").select(*columns) for name, columns in newest["columns"].items()}
    outputs[SCHEMA_NAME] = spark.read.text(f"{folder}/{SCHEMA_NAME}", wholetext=True)
    outputs[SAMPLE_NAME] = spark.read.option("header", True).csv(f"{folder}/{SAMPLE_NAME}")
    return outputs
