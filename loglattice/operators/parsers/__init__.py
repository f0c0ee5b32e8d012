"""Parser families. Importing the package registers the built-in ones."""

from loglattice.operators.parsers import cef, jsonpath, keyvalue, leef, regex, xmlpath  # noqa: F401
from loglattice.operators.parsers.registry import Parser, parser_for, register_parser  # noqa: F401
