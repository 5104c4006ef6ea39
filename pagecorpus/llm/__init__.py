"""Operators of a training-data pipeline over the ``documents``, ``pages`` and ``benchmark``
tables.  Nothing else in the library imports this subpackage."""
