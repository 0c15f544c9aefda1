"""Training-data operators: search, tokens, secrets, mixing, quality, fingerprints, packing, URLs, language and near copies."""
