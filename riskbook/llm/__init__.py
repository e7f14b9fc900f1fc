"""Training-data operators: quality, repetition, tokens, toxicity, secrets,
benchmark leaks, personal data, language, near and exact duplicates."""
