"""Column functions: spectral indices, missing values, similarity, scalar rules."""
