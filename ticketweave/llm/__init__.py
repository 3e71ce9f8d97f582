"""Operators of a training-data pipeline over documents, pages and conversations; nothing else in the library imports them."""
