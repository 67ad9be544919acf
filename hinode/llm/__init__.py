"""Training-data operators: packing, fingerprints, decontamination, scans, near-duplicates, extraction and classifiers."""
