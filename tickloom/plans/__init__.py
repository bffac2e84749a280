"""Scripts: syntax tree, parsers of three dialects, and the compiler to DataFrame stages."""
