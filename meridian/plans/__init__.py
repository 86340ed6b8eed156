"""The registry of queries over the star-schema tables, and their SQL."""
