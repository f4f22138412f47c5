from . import expressions, intervals, sequences

__all__ = ["expressions", "intervals", "sequences"]
