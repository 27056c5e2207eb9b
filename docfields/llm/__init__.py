"""Operators for large-scale training-data preparation.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
