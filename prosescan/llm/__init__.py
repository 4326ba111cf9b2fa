"""Operators for preparing text collections at scale."""
