"""Column expressions: identity, text analysis, query preparation, classification."""
