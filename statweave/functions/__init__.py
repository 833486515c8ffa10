"""Column functions and probability distributions."""
