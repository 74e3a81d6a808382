"""Functions on columns and bytes."""
