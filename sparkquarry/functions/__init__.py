"""Column functions and driver-side scalar helpers."""
