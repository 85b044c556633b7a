"""Histograms over arriving files."""
