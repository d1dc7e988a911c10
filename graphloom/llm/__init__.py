"""Operators for preparing training text: scanning, de-duplicating, scoring, mixing and encoding whole documents.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface; ``queries`` applies
them to the driver's tables.
"""
