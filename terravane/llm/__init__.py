"""Training-data operators: quality, dedup, secrets, mixing, tokenisation, sharding, media."""
