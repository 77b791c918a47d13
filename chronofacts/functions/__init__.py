"""Column functions: time parsing, text clean-up, temporal predicates."""
