"""Column expressions: parsing, flow features, domain tests."""
