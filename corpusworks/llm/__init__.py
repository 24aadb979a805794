"""Training-data operators: mixing, extraction, scans, decontamination, deduplication, classifiers, search."""
