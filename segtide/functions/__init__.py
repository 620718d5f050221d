"""Scalar functions: tokenisers, normalisation, vectors, edit costs."""
