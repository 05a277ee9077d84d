"""The load run and the queries over the loaded table."""
