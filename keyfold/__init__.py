"""Keyed-mutation analytics on PySpark: logs of SET and REMOVE as queryable state."""
