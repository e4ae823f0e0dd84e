"""Registered queries over the driver's tables, and what they render."""
