"""Training-data operators: language, duplicates, contamination, quality, toxicity, mixing, fixity."""
