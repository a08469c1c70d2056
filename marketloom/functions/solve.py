"""Small linear systems as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A pivot below this share of its diagonal is a direction that earlier unknowns span already.
DEPENDENT = 1e-12


def solve_normal(matrix: Sequence[Sequence[Column]], right: Sequence[Column]) -> Column:
    """Solution of symmetric positive semidefinite normal equations as an array, by elimination.

    ``matrix[i][j]`` is needed for j >= i only. Such systems need no pivoting. An unknown whose pivot vanishes,
    since the unknowns before it span it, gets coefficient 0, which leaves fitted values unchanged. NULL
    anywhere gives NULL.
    """
    k = len(right)
    w = k + 1
    full = [[matrix[min(i, j)][max(i, j)] for j in range(k)] + [right[i]] for i in range(k)]
    start = F.array(*[c.cast("double") for row in full for c in row])
    scale = F.array(*[matrix[i][i].cast("double") for i in range(k)])
    known = F.lit(True)
    for row in full:
        for c in row:
            known = known & c.isNotNull()

    def step(a: Column, p: Column) -> Column:
        pivot = F.get(a, p * w + p)
        free = pivot <= F.get(scale, p) * F.lit(DEPENDENT)

        def cell(x: Column, i: Column) -> Column:
            row, col = F.floor(i / w).cast("int"), i % w
            top = F.get(a, p * w + col) / pivot
            return F.when(free, F.when(row == p, F.lit(0.0)).otherwise(x)).when(row == p, top).otherwise(x - F.get(a, row * w + p) * top)

        return F.transform(a, cell)

    done = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), start, step)
    return F.when(known, F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.get(done, i * w + k)))
