"""Expressions: one small tree, two ways to write it (blocks and text), and its translation to a Spark Column."""

from .build import build  # noqa: F401
from .parse import parse  # noqa: F401
from .tree import Node, fields, fold, lit, substitute, walk  # noqa: F401
