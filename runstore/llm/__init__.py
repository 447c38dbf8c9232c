"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator is a plain function from DataFrame to
DataFrame; the registered queries live in :mod:`runstore.llm.queries`.
"""
