"""Column transforms as built-in expressions: keyed hashes, format-preserving encryption, masks, fakes, JSON leaves, text escapes."""
