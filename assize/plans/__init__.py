"""Operators bound to tables: the registered queries and the SQL they are held against."""
