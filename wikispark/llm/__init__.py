"""Training-data operators: archives, extraction, search, mixing, deduplication, classification, tokens and language models.

Nothing else in the library imports this subpackage.
"""
