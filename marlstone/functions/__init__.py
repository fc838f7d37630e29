"""Scalar expressions over columns: prices, quotes, texts, labels and logs."""
