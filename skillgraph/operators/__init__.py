"""Splits, profiles, relations, graph measures, audits, features, metrics and run analytics."""
