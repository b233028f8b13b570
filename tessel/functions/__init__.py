"""Column functions: text, code fingerprints, globs and ordered rules."""
