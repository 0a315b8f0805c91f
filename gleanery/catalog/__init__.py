"""Queries over the shared tables, each with the SQL that must give the same rows.

A query takes ``(spark, folder)``.  Inputs the tables lack (odd URLs, meta tags, service answers) are planted on top of
every row with expressions that mean the same in both SQL dialects.
"""

from gleanery.catalog.registry import queries, sql  # noqa: F401
