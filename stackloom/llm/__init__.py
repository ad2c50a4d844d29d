"""Operations of a training-data pipeline over ``documents``, ``pages`` and ``conversations``.

Nothing else in the library imports this package. ``QUERIES`` and ``SQL`` of ``queries`` are what the entry registers.
"""
