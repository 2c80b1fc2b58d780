"""Column functions: text, geometry, activations."""
