"""The queries of this subpackage, and the SQL that some of them equal."""

from lectern.llm import language, lines, media, mixing, pieces, sharding, simhash, substrings, topk, warc

QUERIES = {
    "op1_histogram_sort": sharding.op1_histogram_sort,
    "op2_suffix_trees": substrings.op2_suffix_trees,
    "op3_sentencepiece": pieces.op3_sentencepiece,
    "op4_pivot_simhash": simhash.op4_pivot_simhash,
    "op5_line_chunks": lines.op5_line_chunks,
    "op6_chunked_warc": warc.op6_chunked_warc,
    "op7_kd_tree_topk": topk.op7_kd_tree_topk,
    "op8_language_filters": language.op8_language_filters,
    "op9_audio_features": media.op9_audio_features,
    "op10_water_filling": mixing.op10_water_filling,
}
ORACLE_SQL = {
    "op1_histogram_sort": sharding.SQL,
    "op2_suffix_trees": substrings.SQL,
    "op5_line_chunks": lines.SQL,
    "op6_chunked_warc": warc.SQL,
    "op7_kd_tree_topk": topk.SQL,
    "op10_water_filling": mixing.SQL,
}
