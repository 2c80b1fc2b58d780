"""Readers and writers of scene files, masks, manifests and result registries."""
