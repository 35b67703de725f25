"""Column functions for text, spans and attributes."""
