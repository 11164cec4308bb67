"""Training-data operators: cleaning, deduplication, scoring and formatting of document tables."""
