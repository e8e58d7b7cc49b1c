"""Column functions and the distributed ordering primitives."""
