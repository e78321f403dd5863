"""Operators for preparing training data for language models.

Thirteen operators, each a module of its own with a general interface, and ``queries.py`` with one
``opN_<name>`` query for each. Nothing else in the library imports this subpackage.
"""
