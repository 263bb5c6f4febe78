"""Relational operators: search, series, rankings, upsert, corpus, lexicon."""
