"""Whole linkage plans, and the queries of this library with their SQL."""
