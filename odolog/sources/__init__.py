"""Readers for trip-log files, folder layouts and stored tables."""
