"""The queries of this subpackage."""

from __future__ import annotations

from tallyflow.llm import centroids, decontamination, divergence, html_text, jaccard, packing, passages, pii, quality, sharding, simhash, tokens, toxicity

MODULES = (sharding, html_text, quality, simhash, toxicity, tokens, packing, pii, passages, decontamination, jaccard, divergence, centroids)


def queries():
    import corpus_pipeline

    return {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items() if sql}
