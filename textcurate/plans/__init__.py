"""Whole jobs built from the operators, and the helpers that keep their plans safe at scale."""
