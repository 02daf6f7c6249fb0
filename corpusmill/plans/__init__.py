"""Workflows: definitions, the compiler to lazy DataFrames, and their catalog."""
