"""Training-data operators: search, de-duplication, language and quality models, token files, mixing, packing."""
