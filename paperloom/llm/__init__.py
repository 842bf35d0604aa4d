"""Training-data operators: packing, filtering, deduplication and tokenisation of text tables."""
