"""Training-data operators: sharding, deduplication, tokenising, language ID, media, search, mixing."""
