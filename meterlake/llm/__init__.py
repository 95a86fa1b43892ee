"""Training-data operators: deduplication, tokenising, mixing, scoring and scanning of document tables."""
