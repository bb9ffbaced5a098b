"""Training-data operators: dedup, search, tokens, packing, licences, PII, sharding, decontamination, toxicity."""
