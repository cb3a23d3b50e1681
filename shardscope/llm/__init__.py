"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from shardscope.llm import (
    exact_dedup,
    mixing,
    ngram_join,
    personal_data,
    ppm,
    quality,
    revisits,
    segmentation,
    spelling,
    substring_dedup,
    token_alignment,
    token_counts,
    vantage,
)

QUERIES = {
    "op1_warc_revisits": revisits.op1_warc_revisits,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_ppm_scoring": ppm.op4_ppm_scoring,
    "op5_vantage_point_trees": vantage.op5_vantage_point_trees,
    "op6_gumbel_segmentations": segmentation.op6_gumbel_segmentations,
    "op7_source_mixing": mixing.op7_source_mixing,
    "op8_personal_data": personal_data.op8_personal_data,
    "op9_ngram_jaccard_join": ngram_join.op9_ngram_jaccard_join,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_token_counts": token_counts.op13_token_counts,
}
ORACLES = {
    "op1_warc_revisits": revisits.SQL,
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_vantage_point_trees": vantage.SQL,
    "op7_source_mixing": mixing.SQL,
    "op9_ngram_jaccard_join": ngram_join.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_spelling_variants": spelling.SQL,
}
