"""Training-data operators: extraction, language, toxicity, deduplication, mixing, tokens."""
