"""Training-data operators: similarity joins, deduplication, scoring, scanning and mixing over document tables."""
