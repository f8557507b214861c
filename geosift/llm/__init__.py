"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries`` holds the registered
``opN_<name>`` queries, which derive their digest columns from the operators.
"""
