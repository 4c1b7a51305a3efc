"""A subset of Cypher, read into DataFrame plans over a catalog."""

from nodeweave.cypher.execute import Execution, run
from nodeweave.cypher.parse import parse

__all__ = ["Execution", "parse", "run"]
