"""Analyses: complete queries built from the operators."""
