"""Registered queries: each builds one result from the tables in a folder."""
