"""Operators of a training-data pipeline over tables of documents, pages and conversations.

Nothing else in the library imports this subpackage. Each operator has a module of its own;
``queries`` registers one query per operator.
"""
