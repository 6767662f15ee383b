"""Operators that prepare text corpora for training: dedup, filters, tokens, packing and chat formats."""
