"""Minimum-cost assignment of many independent problems, one group for each problem."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: edges of at least this cost are forbidden.
FORBIDDEN = 5e29


def least_cost(cost: np.ndarray) -> np.ndarray | None:
    """Column of each row at least total cost (rows <= columns), None if a forbidden edge is needed.

    Rows enter one by one along a shortest path in reduced costs; equal paths take the lower column.
    """
    rows, columns = cost.shape
    if rows > columns:
        return None
    row_price, col_price = np.zeros(rows), np.zeros(columns)
    owner = np.full(columns, -1)
    for entering in range(rows):
        reach, via, done = np.full(columns, np.inf), np.full(columns, -1), np.zeros(columns, bool)
        row, column, far = entering, -1, 0.0
        visited = []
        while True:
            through = far + cost[row] - row_price[row] - col_price
            better = ~done & (through < reach)
            reach[better], via[better] = through[better], column
            column = int(np.where(done, np.inf, reach).argmin())
            far, done[column] = float(reach[column]), True
            if owner[column] < 0:
                break
            visited.append(column)
            row = int(owner[column])
        row_price[entering] += far
        for c in visited:
            row_price[owner[c]] += far - reach[c]
            col_price[c] -= far - reach[c]
        while column >= 0:
            before = int(via[column])
            owner[column] = entering if before < 0 else owner[before]
            column = before
    match = np.full(rows, -1)
    match[owner[owner >= 0]] = np.flatnonzero(owner >= 0)
    return None if (cost[np.arange(rows), match] >= FORBIDDEN).any() else match


def solve(edges: DataFrame) -> DataFrame:
    """edges (problem, row, col, cost) -> (problem, row, col, cost) of the chosen edges.

    Missing edges are forbidden; infeasible problems give one row with null row and col. Of the edges of
    a row only the cheapest count, as many as the problem has rows: others are never needed for the
    least total. So a group holds at most the square of its rows, whatever the number of columns.
    """
    sizes = edges.groupBy("problem").agg(F.countDistinct("row").alias("rows"))
    order = W.partitionBy("problem", "row").orderBy("cost", "col")
    near = edges.withColumn("place", F.row_number().over(order)).join(sizes, "problem").where(F.col("place") <= F.col("rows")).drop("place", "rows")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows, cols = np.unique(group["row"]), np.unique(group["col"])
        cost = np.full((len(rows), len(cols)), 1e30)
        cost[np.searchsorted(rows, group["row"]), np.searchsorted(cols, group["col"])] = group["cost"]
        match = least_cost(cost)
        problem = group["problem"].iloc[0]
        if match is None:
            return pd.DataFrame({"problem": [problem], "row": pd.array([None], "Int64"), "col": pd.array([None], "Int64"), "cost": [None]})
        return pd.DataFrame({"problem": problem, "row": rows, "col": cols[match], "cost": cost[np.arange(len(rows)), match]})

    return near.groupBy("problem").applyInPandas(one, "problem long, row long, col long, cost double")
