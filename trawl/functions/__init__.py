"""Scalar and array functions: text encoding, trigrams, tokens, query terms, patterns."""
