"""Column functions: text, rules and vectors."""
