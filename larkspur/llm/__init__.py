"""Operators for large training-data corpora, and the queries registered for them.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
