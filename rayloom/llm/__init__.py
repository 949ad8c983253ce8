"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it.  Each module holds one operator with
its general interface; :mod:`rayloom.llm.queries` derives the registered
``opN_*`` queries from them.
"""
