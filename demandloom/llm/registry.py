"""Queries of this subpackage for the entry module."""

from __future__ import annotations

from demandloom.llm import langid, lattice_lm, licenses, mips, mixing, neardup, ngram_join, periodic, pieces, quality, spelling, toxicity, warc_fixity


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_tokeniser_fertility(spark, sf_dir):
    return quality.quality_report(_docs(spark, sf_dir))


def op2_language_id(spark, sf_dir):
    return langid.language_report(_docs(spark, sf_dir))


def op3_license_scan(spark, sf_dir):
    return licenses.scan(_docs(spark, sf_dir))


def op4_norm_bucketed_search(spark, sf_dir):
    return mips.search_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_subword_lattice(spark, sf_dir):
    return lattice_lm.score_report(_docs(spark, sf_dir))


def op6_sentencepiece(spark, sf_dir):
    return pieces.encode_report(_docs(spark, sf_dir))


def op7_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_mix_sources(spark, sf_dir):
    return mixing.mix_report(_docs(spark, sf_dir))


def op9_warc_fixity(spark, sf_dir):
    return warc_fixity.audit_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_minhash_near_dedup(spark, sf_dir):
    return neardup.near_report(_docs(spark, sf_dir))


def op11_spelling_variants(spark, sf_dir):
    return spelling.variants_report(_docs(spark, sf_dir))


def op12_ngram_join(spark, sf_dir):
    return ngram_join.join_report(_docs(spark, sf_dir))


def op13_periodic_runs(spark, sf_dir):
    return periodic.runs_report(_docs(spark, sf_dir))


QUERIES = (
    op1_tokeniser_fertility, op2_language_id, op3_license_scan, op4_norm_bucketed_search, op5_subword_lattice, op6_sentencepiece, op7_toxicity,
    op8_mix_sources, op9_warc_fixity, op10_minhash_near_dedup, op11_spelling_variants, op12_ngram_join,
    op13_periodic_runs,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict:
    return {
        "op3_license_scan": licenses.oracle(), "op4_norm_bucketed_search": mips.ORACLE, "op8_mix_sources": mixing.ORACLE, "op9_warc_fixity": warc_fixity.ORACLE,
        "op10_minhash_near_dedup": neardup.ORACLE, "op11_spelling_variants": spelling.ORACLE, "op12_ngram_join": ngram_join.ORACLE,
    }
