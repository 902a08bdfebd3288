"""Column functions: text folding, tokens and grams, message scalars, MIME parsing."""
