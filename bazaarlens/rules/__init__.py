"""Word lists, patterns and lookup tables."""
