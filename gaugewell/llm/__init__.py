"""Training-data operators: mixing, scans, deduplication, language ID, tokenising, search.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
