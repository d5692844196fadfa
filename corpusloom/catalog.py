"""Every registered query of the library outside llm, with its SQL."""

from .plans.oracles import ORACLES
from .plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]
