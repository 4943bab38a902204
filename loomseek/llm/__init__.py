"""Training-data operators: one module for each, their queries in :mod:`loomseek.llm.queries`.

Nothing outside this subpackage imports it.
"""
