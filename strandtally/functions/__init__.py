"""Column functions on sequences, probabilities and library formats."""
