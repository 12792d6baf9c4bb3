"""Column expressions: each takes and gives ``Column``s and stays inside Catalyst."""
