"""Operators for preparing training text and vectors at corpus scale.

Nothing else in the library imports this subpackage; each module holds one operator.
"""
