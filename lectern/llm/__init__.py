"""Operators for preparing training data at scale.

Nothing outside this folder imports it.  ``queries`` holds what is registered
for the driver; every other module is one operator with a general interface.
"""
