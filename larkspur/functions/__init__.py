"""Column expressions: text measures, identities, evaluation cells, persona derivations."""
