"""Column functions: text primitives, word lists, scores and labels."""
