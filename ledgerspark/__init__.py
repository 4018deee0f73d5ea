"""PySpark jobs over small-business ledgers, for all workspaces at once."""
