"""Training-data operators: tokenising, fingerprints, near-duplicate removal, scoring, packing."""
