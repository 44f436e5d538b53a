"""Named queries over the given tables, their SQL equivalents, and dashboard reports."""
