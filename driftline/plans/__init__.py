"""Whole-pipeline plans composed from the operators."""
