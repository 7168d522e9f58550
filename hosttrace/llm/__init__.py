"""Operators for preparing training text: one module for each, and their registered queries in ``queries``."""
