"""Whole jobs composed of the operators: monitoring runs, retraining, retention."""
