"""Formats and stores that alerts and profiles leave in."""
