"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from srcfacts.llm import conversations, embeddings, html, langid, manifest, mixing, pieces, pii, quality, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_simhash": simhash.op2_simhash,
    "op3_embeddings": embeddings.op3_embeddings,
    "op4_pieces": pieces.op4_pieces,
    "op5_quality": quality.op5_quality,
    "op6_html": html.op6_html,
    "op7_langid": langid.op7_langid,
    "op8_pii": pii.op8_pii,
    "op9_secrets": secrets.op9_secrets,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_manifest": manifest.op11_manifest,
    "op12_substrings": substrings.op12_substrings,
    "op13_conversations": conversations.op13_conversations,
}
ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.OP1_SQL, "op11_manifest": manifest.OP11_SQL, "op12_substrings": substrings.OP12_SQL, "op13_conversations": conversations.OP13_SQL}
