"""Training-data operators: language ID, token counts, mixing, extraction, BPE, sharding, near-dedup, search, media, toxicity."""
