"""Training-data operators: de-duplication, privacy, extraction, search, mixing and tokenising.

Nothing else in the library imports this subpackage.
"""
