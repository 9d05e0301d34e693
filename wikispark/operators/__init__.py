"""Operators on DataFrames: one module for each part of the knowledge base."""
