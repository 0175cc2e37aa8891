"""Training-data operators: filters, deduplication, tokenising and formatting of text corpora."""
