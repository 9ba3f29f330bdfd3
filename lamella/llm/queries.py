"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from .bottomk import op12_bottomk_near_duplicates
from .byte_bpe import op7_byte_bpe
from .centroids import op13_centroid_clustering
from .collocations import op11_collocations
from .fingerprints import op1_document_fingerprints
from .id_store import op4_perfect_hash_ids
from .ngram_join import op5_ngram_jaccard_join
from .oracle import ORACLE
from .packing import op8_best_fit_packing
from .pii import op6_pii
from .quality import op3_robust_outliers
from .repeats import op2_repeated_phrases
from .urls import op9_url_filters
from .warc import op10_warc_archives


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_repeated_phrases": op2_repeated_phrases,
    "op3_robust_outliers": op3_robust_outliers,
    "op4_perfect_hash_ids": op4_perfect_hash_ids,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_pii": op6_pii,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filters": op9_url_filters,
    "op10_warc_archives": op10_warc_archives,
    "op11_collocations": op11_collocations,
    "op12_bottomk_near_duplicates": op12_bottomk_near_duplicates,
    "op13_centroid_clustering": op13_centroid_clustering,
    "pipeline": _pipeline,
}

__all__ = ["ORACLE", "QUERIES"]
