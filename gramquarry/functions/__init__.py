"""Column functions over bytes."""
