"""Level-by-level searches; every level is a table in the shared folder."""
