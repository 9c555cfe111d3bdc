"""Registered queries, their fixtures and the SQL they are held against."""
