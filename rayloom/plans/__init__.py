"""Registered queries of the library's own operators, and the tables that they derive from the test data."""
