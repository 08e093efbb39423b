"""Slice tables: which ranges, values and pages a sync reads."""
