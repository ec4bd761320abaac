"""The best machines of a price catalog that are large enough, for catalogs of any number of rows.

A machine serves a need if it has at least its cores and its memory. Sizes of machines come in levels, so a need rounded up
to the next levels of its provider has the same answer as its cell in a grid of (cores, memory). A cell keeps its best
machines and how many fit; it takes over what the cells to the right and above hold, like a staircase. So every row of
the catalog is looked at once, and a need is one look-up, whatever the number of machines that fit it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The provider of needs that any provider may serve.
ANY = "*"

_CELLS = "provider string, cores_level double, memory_level double, fitting long, best array<long>"


def _grid(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Cells of one provider from the best rows of each size: provider, vcpus, memory_gb, n, place, row, in order of place."""
    cores, at_cores = np.unique(rows["vcpus"].to_numpy(), return_inverse=True)
    memory, at_memory = np.unique(rows["memory_gb"].to_numpy(), return_inverse=True)
    none = len(rows)
    ties = pd.factorize(rows["tie"], sort=True)[0]
    order = np.lexsort([ties, rows["price"].to_numpy(), rows["last"].to_numpy()])
    rank = np.empty(none, np.int64)
    rank[order] = np.arange(none)
    best = np.full((len(cores), len(memory), k), none)
    best[at_cores, at_memory, rows["place"].to_numpy() - 1] = rank
    count = np.zeros((len(cores), len(memory)), np.int64)
    count[at_cores, at_memory] = rows["n"].to_numpy()

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sort(np.concatenate([a, b], axis=-1), axis=-1)[..., :k]

    for j in range(len(memory) - 2, -1, -1):
        best[:, j] = merged(best[:, j], best[:, j + 1])
    for i in range(len(cores) - 2, -1, -1):
        best[i] = merged(best[i], best[i + 1])
    count = count[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1]
    ids = rows["row"].to_numpy()[order]
    lists = [ids[b[b < none]].tolist() for b in best.reshape(-1, k)]
    return pd.DataFrame(
        {
            "provider": rows["provider"].iloc[0],
            "cores_level": np.repeat(cores, len(memory)),
            "memory_level": np.tile(memory, len(cores)),
            "fitting": count.ravel(),
            "best": lists,
        }
    )


def fitting(
    needs: DataFrame, catalog: DataFrame, k: int, price: Column | None = None, last: Column | None = None, tie: str = "instance_type"
) -> DataFrame:
    """Per different need (provider, vcpus, memory_gb), a null provider not served and ``ANY`` served by all: ``fitting``,
    the number of machines large enough, and ``best``, the ``k`` first of them as structs, cheapest first. Needs that no
    machine serves have no row.

    ``catalog`` has provider, instance_type, vcpus, memory_gb, hourly_price, local_storage_gb and ``tie``, which orders
    machines of one price and with the first two names a machine. ``price`` replaces the hourly price; where ``last`` holds, machines come after all others.
    """
    shown = ["instance_type", "provider", "vcpus", "memory_gb", "hourly_price", "local_storage_gb"]
    machines = catalog.withColumn("hourly_price", F.col("hourly_price") if price is None else price)
    machines = machines.withColumn("last", F.lit(False) if last is None else last).filter("vcpus IS NOT NULL AND memory_gb IS NOT NULL AND hourly_price IS NOT NULL")
    machines = machines.select(*shown, "last", F.col(tie).alias("tie"), F.xxhash64("provider", "instance_type", tie).alias("row"))
    wanted = needs.select("provider", F.col("vcpus").cast("double").alias("vcpus"), F.col("memory_gb").cast("double").alias("memory_gb")).distinct()
    sized = machines.select(F.explode(F.array("provider", F.lit(ANY))).alias("provider"), F.col("vcpus").cast("double").alias("vcpus"), F.col("memory_gb").cast("double").alias("memory_gb"), "last", F.col("hourly_price").alias("price"), "tie", "row")
    # Only what is asked for: without needs of any provider there is no grid of all of them.
    sized = sized.join(wanted.select("provider").distinct(), "provider", "left_semi")
    size = ["provider", "vcpus", "memory_gb"]
    first = sized.withColumn("place", F.row_number().over(W.partitionBy(*size).orderBy("last", "price", "tie"))).filter(F.col("place") <= k)
    counts = sized.groupBy(*size).agg(F.count(F.lit(1)).alias("n"))
    cells = first.join(counts, size).groupBy("provider").applyInPandas(lambda rows: _grid(rows, k), _CELLS)
    levels = counts.groupBy("provider").agg(F.array_sort(F.collect_set("vcpus")).alias("all_cores"), F.array_sort(F.collect_set("memory_gb")).alias("all_memory"))

    def up(values: str, need: str) -> Column:
        return F.try_element_at(F.filter(values, lambda x: x >= F.col(need)), F.lit(1))

    placed = wanted.join(levels, "provider").select(*size, up("all_cores", "vcpus").alias("cores_level"), up("all_memory", "memory_gb").alias("memory_level"))
    found = placed.join(cells, ["provider", "cores_level", "memory_level"]).filter("fitting > 0")
    named = found.select(*size, "fitting", F.posexplode("best").alias("place", "row")).join(machines.select("row", F.struct(*shown).alias("machine")), "row")
    best = F.transform(F.array_sort(F.collect_list(F.struct("place", "machine"))), lambda x: x["machine"])
    return named.groupBy(*size).agg(F.first("fitting").alias("fitting"), best.alias("best"))


def fitting_runs(runs: DataFrame, catalog: DataFrame, k: int, provider: Column, columns: Sequence[str] = (), **how) -> DataFrame:
    """``columns`` of every run whose executors some machine can hold, with ``fitting`` and ``best``. Runs of one shape share
    the look-up; a shape that very many runs have is one row on the other side."""
    shaped = runs.select(*columns, provider.alias("provider"), F.col("executor_cores").cast("double").alias("vcpus"), (F.col("executor_memory_mb") / 1024.0).alias("memory_gb"))
    return shaped.join(fitting(shaped, catalog, k, **how), ["provider", "vcpus", "memory_gb"])
