"""Training-data operators: sharding, chat parsing, HTML extraction, toxicity, quality, mixing, decontamination,
near-duplicate detection, repeated-passage removal and nearest neighbours.

Nothing outside this package (and ``corpus_pipeline.py``) imports it, so it can be removed as a whole.
"""
