"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import clustering, decontaminate, filteraudit, language, linededup, neardup, neighbours, pieces, pii, preference, quality, toxicity, warc

QUERIES = {
    "op1_language_id": language.op1,
    "op2_sentencepiece": pieces.op2,
    "op3_near_duplicates": neardup.op3,
    "op4_quality": quality.op4,
    "op5_pii": pii.op5,
    "op6_toxicity": toxicity.op6,
    "op7_neighbours": neighbours.op7,
    "op8_preference": preference.op8,
    "op8_preference_all": preference.op8_all,
    "op9_warc": warc.op9,
    "op10_decontaminate": decontaminate.op10,
    "op11_centroid_clusters": clustering.op11,
    "op12_line_dedup": linededup.op12,
    "op13_filter_audit": filteraudit.op13,
}

ORACLES: dict[str, str] = {
    "op8_preference": preference.ORACLE,
    "op8_preference_all": preference.ORACLE_ALL,
    "op9_warc": warc.ORACLE,
    "op11_centroid_clusters": clustering.ORACLE,
    "op12_line_dedup": linededup.ORACLE,
    "op13_filter_audit": filteraudit.ORACLE,
}
