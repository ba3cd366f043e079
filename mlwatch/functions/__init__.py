"""Column builders: expressions only, nothing here touches data."""
