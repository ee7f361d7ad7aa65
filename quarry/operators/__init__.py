"""Relational operators over corpora: dedup, sampling, facets, search, ledgers."""
