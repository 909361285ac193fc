"""Whole runs made of operators, and the catalogue of registered queries."""
