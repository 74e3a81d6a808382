"""Operators over event logs, command journals, membership and signals."""
