"""Part of pagemill."""
