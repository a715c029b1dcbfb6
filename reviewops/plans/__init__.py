"""Registered query plans over the test views and plan checks."""
