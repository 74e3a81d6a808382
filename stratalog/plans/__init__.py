"""Derived tables that the queries share, and the queries' SQL."""
