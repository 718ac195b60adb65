"""The queries over the star schema, and the same in SQL."""
