"""Column expressions: text, scores, arrays, time and statistics."""
