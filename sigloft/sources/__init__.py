"""Landed files, code lists and versioned tables."""
