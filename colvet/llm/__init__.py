"""Training-data operators: near-duplicate search, cleaning, mixing, sharding,
tokenising. Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
