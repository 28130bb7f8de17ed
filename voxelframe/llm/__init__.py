"""Operators for preparing training corpora: sharding, mixing, de-duplication, filtering, scoring and search.

Nothing outside this folder imports it.  Each operator module holds one
operator with a general interface; :mod:`voxelframe.llm.queries` holds the
thin registered queries.
"""
