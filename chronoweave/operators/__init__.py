"""Operators on event trains, templates, graphs and signals."""
