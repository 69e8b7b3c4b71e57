from . import columns, distributions

__all__ = ["columns", "distributions"]
