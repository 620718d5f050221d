"""Index, search, location of matches and their kernels."""
