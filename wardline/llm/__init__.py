"""Corpus preparation for language-model training: dedup, filtering, privacy, mixing.

Nothing else in the library imports this subpackage.
"""
