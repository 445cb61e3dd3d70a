"""Relational operators: events, documents, matching, targets, features, profiles."""
