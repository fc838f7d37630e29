"""Relational operators that Spark lacks as such: as-of joins, latest rows, gaps, islands, null-safe differences, bars, ladders."""
