"""Estimators that draw samples in increments and stop by a rule."""
