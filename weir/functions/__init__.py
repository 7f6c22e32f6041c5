"""Scalar functions, counts and labels, fingerprints."""
