"""Operators for preparing training text at scale: classifiers, de-duplication, mixing and packing.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
