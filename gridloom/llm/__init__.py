"""Training-data operators: deduplication, packing, filtering, scanning, formatting, extraction."""
