"""Training-data operators: quality, decontamination, deduplication, scoring, scans, mixing."""
