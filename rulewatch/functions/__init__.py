"""Column helpers: calendar, predicates, values and hashes."""
