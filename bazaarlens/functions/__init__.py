"""Column -> Column functions over listing text, prices, identifiers and urls."""
