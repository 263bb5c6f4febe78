"""Distributed TF-IDF features and logistic regression."""
