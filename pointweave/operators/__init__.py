"""Relational operators over scenes, views, regions, tracks and objects."""
