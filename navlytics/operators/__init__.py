"""Relational operators; every one keeps any single task's share of the data bounded."""
