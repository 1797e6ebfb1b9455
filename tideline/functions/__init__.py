"""Column expressions: time arithmetic, hashing, space-filling codes, numeric rules."""
