"""Training-data operators: token counts, mixing, media, deduplication, output formats, packing and quality.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
