"""Column functions: tokenizers, segments, templates, vectors."""
