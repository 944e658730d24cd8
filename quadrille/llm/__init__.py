"""Operators for preparing training corpora: filtering, deduplication, mixing, packing, sharding, vector search.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
