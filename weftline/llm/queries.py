"""The operators as queries over the driver's tables, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import convrepair, decon, fingerprint, html_sst, jaccard, langid, packing, pii, quality, secretscan, spelling, urltree, warc
from .common import documents, pages
from .oracles import ORACLES


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_site_style(spark, sf_dir):
    """Main text of every page."""
    return html_sst.op1(spark, pages(spark, sf_dir))


def op2_warc_salvage(spark, sf_dir):
    """Every page written to WARC archives and read back."""
    return warc.op2(spark, pages(spark, sf_dir))


def op3_language_id(spark, sf_dir):
    """Language of every document."""
    return langid.op3(spark, documents(spark, sf_dir))


def op4_secret_scan(spark, sf_dir):
    """Spans of secrets in every document."""
    return secretscan.op4(spark, documents(spark, sf_dir))


def op5_pii_feistel(spark, sf_dir):
    """Every document with pseudonyms for personal numbers and dates."""
    return pii.op5(spark, documents(spark, sf_dir))


def op6_quality_rules(spark, sf_dir):
    """Metrics and verdict of every document."""
    return quality.op6(spark, documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark, sf_dir):
    """Components of documents with 3-word shingle Jaccard of 0.9 or more."""
    return jaccard.op7(spark, documents(spark, sf_dir))


def op8_url_tree(spark, sf_dir):
    """Verdict on every page's url."""
    return urltree.op8(spark, pages(spark, sf_dir))


def op9_decontamination(spark, sf_dir):
    """Documents that hold benchmark items."""
    return decon.op9(spark, documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op10_best_fit_packing(spark, sf_dir):
    """Every document's pieces in bins."""
    return packing.op10(spark, documents(spark, sf_dir))


def op11_spelling_variants(spark, sf_dir):
    """Spelling variants of the vocabulary of all documents."""
    return spelling.op11(spark, documents(spark, sf_dir))


def op12_canonical_digest(spark, sf_dir):
    """Fingerprints of every document, of its edited text and of the next document."""
    return fingerprint.op12(spark, documents(spark, sf_dir))


def op13_conversation_repair(spark, sf_dir):
    """Damaged conversations with their cheapest repairs."""
    return convrepair.op13(spark, _table(spark, sf_dir, "conversations"))


def queries():
    """All by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    """DuckDB SQL of those that SQL can express."""
    return dict(ORACLES)
