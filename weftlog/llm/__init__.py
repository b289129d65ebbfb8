"""Training-data operators: packing, near duplicates, quality, privacy, token files, language, secrets, leaks, URLs, fingerprints."""
