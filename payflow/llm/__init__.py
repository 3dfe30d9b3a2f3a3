"""Operators of a training-data pipeline over ``documents``, ``pages``, ``benchmark`` and ``labels``.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` registers its queries
only when it is present.
"""
