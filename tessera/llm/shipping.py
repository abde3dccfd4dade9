"""Make this package importable in the Python workers of any cluster."""

from tessera.shipping import ship

__all__ = ["ship"]
