"""Column -> Column rules: keys, names, money, sizes, classification, scores."""
