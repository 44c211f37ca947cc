"""Training-data operators: archives, tokenisation, secrets, mixing, deduplication, search, quality, URL rules."""
