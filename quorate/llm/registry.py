"""Queries of the pipeline operators, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import as_of, chat, decontaminate, language, lines, multi_index, negatives, ngram_model, packing, quality, shingle_join, simhash, urls

QUERIES = {
    "op1_language_id": language.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_simhash_near_dedup": simhash.op3,
    "op4_quality_classifier": quality.op4,
    "op5_packing": packing.op5,
    "op6_url_filters": urls.op6,
    "op7_lm_scoring": ngram_model.op7,
    "op8_chat_formatting": chat.op8,
    "op9_approximate_neighbours": multi_index.op9,
    "op10_line_dedup": lines.op10,
    "op11_as_of_join": as_of.op11,
    "op12_hard_negatives": negatives.op12,
    "op13_shingle_join": shingle_join.op13,
}

ORACLES: dict[str, str] = {"op11_as_of_join": as_of.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_shingle_join": shingle_join.ORACLE}
