"""Corpus preparation operators for training data, one module an operator.

Nothing outside this subpackage imports it.
"""
