"""Column builders: distances, filters, text, tenant ids."""
