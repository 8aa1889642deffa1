"""Structured Streaming forms of the resampling and window operators."""
