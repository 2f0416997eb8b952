"""Contracts, fixed values and ready-made profiles."""
