"""Corpus operators: fixity, language, tokens, duplicates, contamination, extraction, licences."""
