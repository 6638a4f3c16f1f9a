"""Registered queries over the driver's tables, and cached results."""
