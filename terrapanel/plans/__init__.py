"""Whole jobs: feature tables, the model table, models and text roll-ups."""
