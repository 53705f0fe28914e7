"""Helpers shared by the operators: storage, fixpoints, ranking and array expressions."""
