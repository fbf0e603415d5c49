"""Registered queries: every operator on the driver tables, with an independent SQL statement where SQL can say it."""

from popweave.catalog import areas, files, people, shapes, tables_and_joins, text_and_pages  # noqa: F401
from popweave.catalog.registry import ORACLES, QUERIES  # noqa: F401
