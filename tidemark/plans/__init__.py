"""Whole queries made of operators, and the registry of queries."""
