"""Training-data operators: near-dedup, secrets, sharding, BPE, packing, fingerprints, HTML, toxicity, quality, URLs."""
