"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from drawlake.llm import embeddings, licenses, minhash, mixing, pii, quality, repair, rollups, secrets, sentencepieces, shards, spelling, toolcalls


def queries() -> dict:
    return {"op1_secrets": secrets.op1_secrets, "op2_pii": pii.op2_pii, "op3_hnsw": embeddings.op3_hnsw, "op4_quality_rules": quality.op4_quality_rules, "op5_tool_links": toolcalls.op5_tool_links, "op6_superminhash": minhash.op6_superminhash, "op7_license_scan": licenses.op7_license_scan, "op8_token_rollups": rollups.op8_token_rollups, "op9_sentencepiece": sentencepieces.op9_sentencepiece, "op10_mix_sources": mixing.op10_mix_sources, "op11_spelling_variants": spelling.op11_spelling_variants, "op12_conversation_repair": repair.op12_conversation_repair, "op13_shards": shards.op13_shards}


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": secrets.SQL, "op2_pii": pii.SQL, "op3_hnsw": embeddings.SQL, "op5_tool_links": toolcalls.SQL, "op6_superminhash": minhash.SQL, "op7_license_scan": licenses.SQL, "op10_mix_sources": mixing.SQL, "op11_spelling_variants": spelling.SQL, "op12_conversation_repair": repair.SQL, "op13_shards": shards.SQL}
