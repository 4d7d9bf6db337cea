"""Scalar functions: digests, hex, paths, glob patterns and the optional ciphers."""
