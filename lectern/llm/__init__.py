"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``registry`` wires
them to the queries ``opN_<name>``.  Nothing outside this subpackage imports it.
"""
