"""Scalar functions: digests, canonical bytes, values, clocks, signatures."""
