"""Column functions: the pure rules of the domain."""
