"""Training-data operators: archives, search, packing, near-duplicates, models, tokens and filters."""
