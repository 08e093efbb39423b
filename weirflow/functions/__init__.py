"""Column functions: truth of loose values, text, hashes, dates."""
