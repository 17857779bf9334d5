"""Column expressions: text, keyword flags, time parts, risk tiers. No Python UDFs."""
