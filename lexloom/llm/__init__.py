"""Operators for large training-data pipelines; nothing else in lexloom imports this."""
