"""Training-data operators: toxicity, dedup, decontamination, quality, PII, search, secrets, packing."""
