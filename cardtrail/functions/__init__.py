"""Column expressions: predicates, the card digest, row rendering."""
