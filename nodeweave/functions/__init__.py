"""Predicates, aggregates and scalar functions as expression trees over model attributes."""

from nodeweave.functions.aggregates import Aggregate, avg, collect, count, max_, min_, sum_
from nodeweave.functions.predicates import Comparison, Logical, Negated, Predicate

__all__ = ["Aggregate", "Comparison", "Logical", "Negated", "Predicate", "avg", "collect", "count", "max_", "min_", "sum_"]
