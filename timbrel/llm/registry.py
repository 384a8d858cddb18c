"""The corpus operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import corpus_pipeline
from timbrel.llm import exact_dedup, license_scan, media, mixing, ngram_join, packing, quality, toxicity, url_filter, wavelet

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_wavelet_tokens": wavelet.op8_wavelet_tokens,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_media_columns": media.op10_media_columns,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op4_exact_dedup": exact_dedup.OP4_SQL, "op6_url_filter": url_filter.OP6_SQL}
