"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from strataweave.llm import ctw_query, jaccard_query, media_query, mil_query, mixing_query, packing_query, pii_query, secrets_query, sharding_query, topk_query

QUERIES = {}
ORACLES = {}

for _module in (media_query, mil_query, secrets_query, topk_query, ctw_query, packing_query, pii_query, jaccard_query, mixing_query, sharding_query):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
