"""Column-wise numeric functions over expression tables."""
