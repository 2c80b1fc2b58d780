"""Stateful operators for progress streams."""
