"""All registered queries: importing the modules registers them."""

from . import collections, comparison, files, spatial, stands  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
