"""The queries of this subpackage, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

import corpus_pipeline
from quadrant.llm import chat, codes, manifest, mixing, near_dedup
from quadrant.llm.chat import op6_chat
from quadrant.llm.codes import op13_codes
from quadrant.llm.fingerprints import op1_fingerprints
from quadrant.llm.lm_scoring import op8_lm_scoring
from quadrant.llm.manifest import op12_manifest
from quadrant.llm.mixing import op3_mixing
from quadrant.llm.near_dedup import op7_near_dedup
from quadrant.llm.neighbours import op2_neighbours
from quadrant.llm.packing import op5_packing
from quadrant.llm.secrets import op4_secrets
from quadrant.llm.simhash import op11_simhash
from quadrant.llm.toxicity import op10_toxicity
from quadrant.llm.urls import op9_urls


def queries() -> dict:
    return {"op1_fingerprints": op1_fingerprints, "op2_neighbours": op2_neighbours, "op3_mixing": op3_mixing, "op4_secrets": op4_secrets, "op5_packing": op5_packing, "op6_chat": op6_chat, "op7_near_dedup": op7_near_dedup, "op8_lm_scoring": op8_lm_scoring, "op9_urls": op9_urls, "op10_toxicity": op10_toxicity, "op11_simhash": op11_simhash, "op12_manifest": op12_manifest, "op13_codes": op13_codes, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    found = {"op3_mixing": mixing.SQL, "op6_chat": chat.SQL, "op7_near_dedup": near_dedup.SQL, "op12_manifest": manifest.SQL, "op13_codes": codes.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}
    return {name: sql for name, sql in found.items() if sql}
