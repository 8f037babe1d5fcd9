"""Queries over the given tables: each module holds queries and, where SQL can state them, equal SQL texts."""
