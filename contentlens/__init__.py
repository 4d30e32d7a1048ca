"""contentlens: content-platform analytics as Spark DataFrame jobs.

Public functions take a :class:`~contentlens.sources.tables.ContentTables`
(or single DataFrames) and return lazy DataFrames.  Nothing in the library
collects rows to the driver.
"""

from contentlens.sources.tables import ContentTables, load_tables, save_tables

__all__ = ["ContentTables", "load_tables", "save_tables"]
__version__ = "0.1.0"
