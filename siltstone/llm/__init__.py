"""Training-data operators: dedup, fingerprints, classifiers, mixing, archives and packing."""
