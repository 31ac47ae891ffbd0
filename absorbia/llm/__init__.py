"""Training-data operators: packing, quality, near-duplicates, PII and the like."""
