"""Operators for large text corpora: URL rules, mixing, extraction, tokenising, scoring and joins.

Nothing outside this package imports it, apart from ``corpus_pipeline.py`` and
a guarded block in ``__spark_entry__.py``.
"""
