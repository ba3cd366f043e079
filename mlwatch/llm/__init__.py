"""Operators for preparing text that language models are trained on. Nothing else in the library imports them."""
