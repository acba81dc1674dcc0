"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from gridsmith.llm import fingerprints, linededup, media, mixing, neardup, pagetext, pieces, secrets, toxicity, urls

QUERIES = {
    "op1_linededup": linededup.query,
    "op2_mixing": mixing.query,
    "op3_media": media.query,
    "op4_pagetext": pagetext.query,
    "op5_pieces": pieces.query,
    "op6_toxicity": toxicity.query,
    "op7_neardup": neardup.query,
    "op8_urls": urls.query,
    "op9_secrets": secrets.query,
    "op10_fingerprints": fingerprints.query,
}
ORACLE_SQL: dict[str, str] = {"op1_linededup": linededup.ORACLE_SQL, "op2_mixing": mixing.ORACLE_SQL}
