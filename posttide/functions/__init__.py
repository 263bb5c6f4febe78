"""Column expressions: text cleaning, labels, scores, fetched documents."""
