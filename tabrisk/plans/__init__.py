"""End-to-end plans: prepare, train, explain, append."""
