"""Operators on documents for language-model corpora. Nothing outside of this package imports it."""
