"""Training-data operators: extraction, filtering, deduplication, scoring, mixing, tokens and archives.

Nothing outside this subpackage imports it; ``corpus_pipeline.py`` and the driver entry do.
"""
