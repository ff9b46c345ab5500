"""The attribute filter language: parser, tree, predicate plan, posting plan, and the choice between the two.

``{"k": "v"}`` equals, ``{"k": {"$in": [...]}}``, siblings are joined by and,
``{"$or": [..]}``, ``{"$not": {..}}``.  Logic is two-valued: a missing key
makes a leaf false, so its negation is true.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FilterError(ValueError):
    code = "bad_request"


class UnsupportedOperator(FilterError):
    code = "unsupported_operator"

    def __init__(self, key: str, operator: str):
        super().__init__(f"{key}: {operator}")
        self.key, self.operator = key, operator


class AmbiguousFilter(FilterError):
    def __init__(self, key: str, siblings: list[str]):
        super().__init__(f"{key} stands beside {', '.join(siblings)}")
        self.key, self.siblings = key, siblings


@dataclass(frozen=True)
class Equals:
    key: str
    value: str


@dataclass(frozen=True)
class In:
    key: str
    values: frozenset[str]


@dataclass(frozen=True)
class And:
    terms: tuple


@dataclass(frozen=True)
class Or:
    terms: tuple


@dataclass(frozen=True)
class Not:
    term: Any


Expr = Equals | In | And | Or | Not
_NAMES = {bool: "Boolean", int: "Integer", float: "Double", list: "ArrayList", dict: "LinkedHashMap", str: "String"}


def _kind(x: Any) -> str:
    return "null" if x is None else _NAMES.get(type(x), type(x).__name__)


def parse(doc: dict[str, Any] | None) -> Expr | None:
    """The tree of a filter document; None for no filter."""
    if not doc:
        return None
    if "$or" in doc and len(doc) > 1:
        raise AmbiguousFilter("$or", [k for k in doc if k != "$or"])
    terms = [_term(k, v) for k, v in doc.items()]
    return terms[0] if len(terms) == 1 else And(tuple(terms))


def _clause(key: str, doc: Any) -> Expr:
    if not isinstance(doc, dict):
        raise UnsupportedOperator(key, _kind(doc))
    if not doc:
        raise UnsupportedOperator(key, "empty_clause")
    return parse(doc)


def _term(key: str, value: Any) -> Expr:
    if key == "$or":
        if not isinstance(value, list):
            raise UnsupportedOperator(key, _kind(value))
        if not value:
            raise UnsupportedOperator(key, "empty_array")
        clauses = tuple(_clause(key, x) for x in value)
        return clauses[0] if len(clauses) == 1 else Or(clauses)
    if key == "$not":
        return Not(_clause(key, value))
    if key.startswith("$"):
        raise UnsupportedOperator(key, key)
    if isinstance(value, str):
        return Equals(key, value)
    if not isinstance(value, dict) or not value:
        raise UnsupportedOperator(key, _kind(value))
    first = next(iter(value))
    if list(value) != ["$in"]:
        raise UnsupportedOperator(key, first)
    items = value["$in"]
    if not isinstance(items, list):
        raise UnsupportedOperator(key, f"$in:{_kind(items)}")
    if not items:
        raise UnsupportedOperator(key, "$in:empty_array")
    for x in items:
        if not isinstance(x, str):
            raise UnsupportedOperator(key, f"$in:{_kind(x)}")
    return In(key, frozenset(items))


def term_count(e: Expr | None) -> int:
    """Leaves; an $in is one."""
    match e:
        case None:
            return 0
        case And(terms) | Or(terms):
            return sum(map(term_count, terms))
        case Not(term):
            return term_count(term)
    return 1


def keys(e: Expr | None) -> set[str]:
    match e:
        case None:
            return set()
        case And(terms) | Or(terms):
            return set().union(*map(keys, terms))
        case Not(term):
            return keys(term)
    return {e.key}


def to_column(e: Expr | None, attribute=lambda k: F.col("attributes")[k]) -> Column:
    """The predicate, never null; ``attribute`` gives the column of a key, so promoted columns reach the scan."""
    match e:
        case None:
            return F.lit(True)
        case Equals(key, value):
            return F.coalesce(attribute(key) == F.lit(value), F.lit(False))
        case In(key, values):
            return F.coalesce(attribute(key).isin(sorted(values)), F.lit(False))
        case And(terms):
            return reduce(lambda a, b: a & b, [to_column(t, attribute) for t in terms])
        case Or(terms):
            return reduce(lambda a, b: a | b, [to_column(t, attribute) for t in terms])
        case Not(term):
            return ~to_column(term, attribute)
    raise TypeError(e)


def from_postings(e: Expr, postings: DataFrame, domain: DataFrame) -> DataFrame:
    """(segment_id, ordinal) of the rows that a tree accepts, from exploded lists (segment_id, key, value, ordinal).

    domain holds all (segment_id, ordinal); negation is a difference from it.
    """
    on = ["segment_id", "ordinal"]
    match e:
        case Equals(key, value):
            return postings.where((F.col("key") == key) & (F.col("value") == value)).select(*on)
        case In(key, values):
            return postings.where((F.col("key") == key) & F.col("value").isin(sorted(values))).select(*on).distinct()
        case And(terms):
            return reduce(lambda a, b: a.join(b, on, "left_semi"), [from_postings(t, postings, domain) for t in terms])
        case Or(terms):
            return reduce(lambda a, b: a.union(b), [from_postings(t, postings, domain) for t in terms]).distinct()
        case Not(term):
            return domain.select(*on).join(from_postings(term, postings, domain), on, "left_anti")
    raise TypeError(e)


def choose(e: Expr | None, indexed: set[str]) -> str:
    """"posting" if every key of the filter has lists, else "scan"; "all" without a filter."""
    return "all" if e is None else "posting" if keys(e) <= indexed else "scan"


def ratio_bucket(accepted: Column, size: Column) -> Column:
    """The quarter that accepted / size lies in; lower ends belong to it, an empty segment to the first."""
    share = F.when(size > 0, accepted / size).otherwise(F.lit(0.0))
    return F.when(share < 0.25, "0-25").when(share < 0.5, "25-50").when(share < 0.75, "50-75").otherwise("75-100")
