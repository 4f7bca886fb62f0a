"""Filters, aggregates, rolling windows and motifs."""
