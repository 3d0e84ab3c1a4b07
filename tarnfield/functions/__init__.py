"""Column functions: text, paths, citations."""
