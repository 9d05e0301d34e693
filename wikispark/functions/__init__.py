"""Column functions: text, predicates, vectors."""
