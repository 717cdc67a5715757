"""Corpus-preparation operators: deduplication, filtering, tokenisation, mixing and packing.

Nothing outside this subpackage imports it.
"""
