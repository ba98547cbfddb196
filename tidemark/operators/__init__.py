"""Relational operators on stays, hours and measurements."""
