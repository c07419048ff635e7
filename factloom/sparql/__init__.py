"""A SPARQL front end: text -> syntax tree -> DataFrame over a fact table."""

from .compiler import Result, query
from .parser import SparqlError, parse

__all__ = ["Result", "SparqlError", "parse", "query"]
