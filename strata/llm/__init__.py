"""Training-data operators: packing, personal data, fingerprints, BPE, token
files, repeated passages, quality, near duplicates, web archives, language
models. Nothing else in the library imports this subpackage."""
