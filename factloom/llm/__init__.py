"""Training-data operators: deduplication, language ID, mixing, PII, tokenisation and vector search."""
