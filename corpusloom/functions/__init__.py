"""Column functions: text, URLs, HTML, chunks, vectors, rules."""
