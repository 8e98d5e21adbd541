"""Readers and writers of the monitored tables."""
