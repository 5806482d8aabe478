"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from ..session import ship
from . import byte_bpe, chat_format, html_blocks, jaccard_join, license_scan, packing, quality_classifier, quality_rules, tiff, warc
from .common import table

_QUERIES = {
    "op1_quality_classifier": lambda spark, d: quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_warc": lambda spark, d: warc.round_trip(table(spark, d, "pages")),
    "op3_html_blocks": lambda spark, d: html_blocks.extract(table(spark, d, "pages")),
    "op4_jaccard_join": lambda spark, d: jaccard_join.near_duplicates(table(spark, d, "documents")),
    "op5_license_scan": lambda spark, d: license_scan.scan(table(spark, d, "documents")),
    "op6_quality_rules": lambda spark, d: quality_rules.measured(table(spark, d, "documents")),
    "op7_hilbert_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op8_byte_bpe": lambda spark, d: byte_bpe.round_trip(table(spark, d, "documents")),
    "op9_tiff_media": lambda spark, d: tiff.round_trip(table(spark, d, "documents")),
    "op10_chat_format": lambda spark, d: chat_format.formatted(table(spark, d, "conversations")),
}


def _shipping(query):
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {name: _shipping(query) for name, query in _QUERIES.items()}
ORACLES: dict[str, str] = {
    "op2_warc": warc.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
}
