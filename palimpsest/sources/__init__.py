"""Readers of raw logs."""
