"""Column functions: offsets of matches, claims, number words, fixed word lists."""
