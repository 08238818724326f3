"""Operators on text and source code for training data."""
