"""Registered queries (catalog) and inputs derived from the driver tables (fixtures)."""
