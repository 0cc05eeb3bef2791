"""Whole plans: reconciliation, views, emission, configuration and profiles."""
