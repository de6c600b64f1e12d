"""Training-data operators: extraction, de-duplication, quality, privacy, search, packing and mixing."""
