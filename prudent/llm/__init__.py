"""Training-data operators: URL filters, PII, near-duplicates, quality, language, packing, token files, mixing."""
