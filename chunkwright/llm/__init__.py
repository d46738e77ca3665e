"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` and ``oracles`` in
``chunkwright.llm.registry`` list the registered queries.
"""
