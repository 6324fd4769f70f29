"""Column functions: text, URLs, dates, predicates, similarity and HTML."""
