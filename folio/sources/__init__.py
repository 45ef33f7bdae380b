"""Inputs, dimensions and stored tables."""
