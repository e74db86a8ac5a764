"""The 33-column text form of the flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import hexfmt
from flowloom.schema import FLOW_CSV_COLUMNS, HELLO_TYPE


def with_hello_columns(flows: DataFrame) -> DataFrame:
    """Spell out the nullable ``hello`` struct; flows without one get placeholders."""
    if "hello" not in flows.columns:
        flows = flows.withColumn("hello", F.lit(None).cast(HELLO_TYPE))
    hello = F.col("hello")

    def seen(value, missing):
        return F.when(hello.isNotNull(), value).otherwise(F.lit(missing))

    return flows.withColumns(
        {
            "tls_client_hello_c2s": hello.isNotNull().cast("long"),
            "ja4_legacy_version": seen(hexfmt.hex4(hello["legacy_version"]), "-"),
            "ja4_cipher_suites_count": seen(F.size(hello["cipher_suites"]), 0).cast("long"),
            "ja4_extensions_count": seen(F.size(hello["extensions"]), 0).cast("long"),
            "ja4_has_sni": seen(hello["has_sni"].cast("int"), 0).cast("long"),
            "ja4_alpn": seen(hexfmt.join_or_dash(hexfmt.bytes_as_text(hello["alpn_protocols"])), "-"),
            "ja4_cipher_suites": seen(hexfmt.hex_list(hello["cipher_suites"]), "-"),
            "ja4_extensions": seen(hexfmt.hex_list(hello["extensions"]), "-"),
        }
    ).drop("hello")


def export_rows(flows: DataFrame) -> DataFrame:
    """The rows of a flow CSV file: 33 columns, average to three decimals."""
    average = hexfmt.fixed3_text(F.col("avg_wirelen_total"))
    rows = with_hello_columns(flows).withColumn("avg_wirelen_total", average)
    return rows.select(*FLOW_CSV_COLUMNS)
