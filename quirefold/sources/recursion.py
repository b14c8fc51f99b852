"""Recursive SQL over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quirefold.sources.shared import as_table

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def recursive(sql: str, **tables: DataFrame) -> DataFrame:
    """The rows of a ``WITH RECURSIVE`` query over the tables, as a table in the shared folder, without a limit on their number; the session's own limit is put back.

    For chains and trees, where every row leads to few others: recursion adds all that it finds, so a graph that leads to a node by many ways needs a frontier without what was seen. A table instead of
    a checkpoint, as a checkpoint would keep what the optimiser believes of the recursion's inner columns.
    """
    conf = next(iter(tables.values())).sparkSession.conf
    before = conf.get(ROW_LIMIT)
    conf.set(ROW_LIMIT, "-1")
    try:
        return as_table(next(iter(tables.values())).sparkSession.sql(sql, **tables), "recursion")
    finally:
        conf.set(ROW_LIMIT, before)
