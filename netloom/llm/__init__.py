"""Training-data operators for text corpora (mixing, filtering, dedup, archives, tokens)."""
