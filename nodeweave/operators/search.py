"""Full-text and nearest-neighbour search."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nodeweave.exceptions import MetadataError
from nodeweave.model import Node
from nodeweave.plans.spec import FulltextSource, VectorSource

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


def fulltext(df: DataFrame, cls: type[Node], source: FulltextSource, catalog) -> DataFrame:
    """Nodes whose indexed text has every word of the query (mode "any": one), as whole words, without stemming.

    The fields are those given, else all with a full-text index of the model or of the catalog.
    """
    fields = list(source.fields) or [n for n, f in cls.fields.items() if f.index_kind == "FULLTEXT"] or catalog.fulltext_fields(cls.primary_label)
    if not fields:
        raise MetadataError(f"{cls.__name__} has no full-text field")
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise MetadataError(f"{cls.__name__} has no field {', '.join(missing)}")
    ignored = catalog.stopwords(cls.primary_label)
    wanted = [w for w in dict.fromkeys(words(source.text)) if w not in ignored]
    if not wanted:
        return df.limit(0)
    # A word must occur as text before it can be a word: cheaper than splitting every text.
    text = F.lower(F.concat_ws(" ", *fields))
    tokens = F.split(text, WORD_BREAK)
    has = [F.contains(text, F.lit(w)) & F.array_contains(tokens, w) for w in wanted]
    condition = has[0]
    for c in has[1:]:
        condition = condition & c if source.mode == "all" else condition | c
    return df.filter(condition)


def distance(column: Column, source: VectorSource) -> Column:
    """Euclidean or cosine distance in double precision; null for a null vector or one of another length."""
    query = F.array(*(F.lit(float(x)) for x in source.vector))
    v = F.transform(column, lambda x: x.cast("double"))
    add = lambda pairs: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)
    if source.metric == "euclidean":
        d = F.sqrt(add(F.zip_with(v, query, lambda a, b: (a - b) * (a - b))))
    elif source.metric == "cosine":
        norm = sum(float(x) ** 2 for x in source.vector) ** 0.5
        d = 1 - add(F.zip_with(v, query, lambda a, b: a * b)) / F.nullif(F.sqrt(add(F.transform(v, lambda a: a * a))) * F.lit(norm), F.lit(0.0))
    else:
        raise ValueError(f"unknown metric {source.metric!r}")
    return F.when(F.size(column) == len(source.vector), d)
