"""Workflows that chain operators, and the catalog of registered queries."""
