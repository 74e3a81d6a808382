"""Where logs, keyspaces and sets are read from and written to."""
