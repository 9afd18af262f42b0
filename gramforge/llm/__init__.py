"""Training-data operators: quality, language, dedup, decontamination, PII, secrets, sharding, mixing, token files."""
