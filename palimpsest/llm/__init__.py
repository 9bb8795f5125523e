"""Corpus-preparation operators for language-model training data.

Self-contained: nothing else in the library imports this subpackage.
"""
