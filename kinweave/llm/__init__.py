"""Operators for preparing training data; see the README's table for the ten of them."""
