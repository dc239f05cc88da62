"""Registered queries: an operator applied to the supplied tables, with its SQL twin."""
