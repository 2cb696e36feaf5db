"""Relational operators: pseudonymizing projection, subset closure, rule compiler, privacy analytics."""
