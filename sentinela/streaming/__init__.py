"""Streaming use of the stateless operators."""
