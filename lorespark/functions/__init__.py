"""Column functions: Unicode-safe text, cleaning, templates, interface strings."""
