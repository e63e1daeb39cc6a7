"""From hosts to stamps: coadd lookup, cell depth, walk order, parts and the stop at a target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from stampmill.functions.draws import draw
from stampmill.operators.keyed import sendable
from stampmill.operators.ordering import global_prefix_sum, global_row_number

CELL_PX = 150
GUARD_HOSTS = 20
COADD = ["tract", "patch", "band_idx"]


def cell_visit_counts(contributions: DataFrame) -> DataFrame:
    """Distinct visits per coadd cell; detectors of one visit count once."""
    if contributions.isEmpty():
        raise ValueError("no contributions: every coadd is built from visits")
    return contributions.groupBy(*COADD, "cell_i", "cell_j").agg(F.countDistinct("visit").alias("n_visits"))


def _unique_coadds(coadds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row per (tract, patch, band) in the asked bands; a repeat fails the job."""
    found = coadds.where(F.col("band").isin(list(bands))).groupBy(*COADD, "band").agg(F.count(F.lit(1)).alias("_n"))
    repeat = F.raise_error(F.lit("a coadd is listed twice for one tract, patch and band")).cast("boolean")
    return found.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(repeat)).drop("_n")


def host_coadds(hosts: DataFrame, coadds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """One row per host and band that has a coadd."""
    return hosts.join(_unique_coadds(coadds, bands), ["tract", "patch"])


def hosts_without_coadd(hosts: DataFrame, coadds: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Hosts whose patch has no coadd in any asked band."""
    covered = coadds.where(F.col("band").isin(list(bands))).select("tract", "patch")
    return hosts.join(covered, ["tract", "patch"], "left_anti")


def covered_cells(size: int, cell: int = CELL_PX) -> Column:
    """The (i, j) cells a stamp at (x, y) covers: i runs along x, j along y."""
    half = size // 2
    span = f"sequence(floor((bround({{0}}) - {half}) / {cell}), floor((bround({{0}}) + {half - 1}) / {cell}))"
    return F.expr(f"flatten(transform({span.format('x')}, i -> transform({span.format('y')}, j -> struct(i, j))))")


def _cell_key(i: str, j: str) -> str:
    """One number per cell; a patch has far fewer than 2^20 cells a side."""
    return f"(CAST({i} AS BIGINT) * 1048576 + {j})"


def depth_maps(visits: DataFrame) -> DataFrame:
    """One map of cell to visits per coadd; a coadd has no more cells than its grid."""
    entry = f"map_from_entries(collect_list(struct({_cell_key('cell_i', 'cell_j')}, n_visits)))"
    return visits.groupBy(*COADD).agg(F.expr(entry).alias("depths"))


def with_depth(stamps: DataFrame, visits: DataFrame, size: int) -> DataFrame:
    """Add cells spanned, cells not built, lowest and highest visit count, and their ratio.

    One join on the coadd key; a cell without visits counts 0, and a lowest count of 0 is an
    infinite ratio.
    """
    joined = stamps.join(depth_maps(visits), COADD, "left").withColumn("_cells", covered_cells(size))
    seen = f"transform(_cells, c -> coalesce(depths[{_cell_key('c.i', 'c.j')}], 0L))"
    counted = joined.withColumn("_seen", F.expr(seen))
    named = counted.selectExpr(*stamps.columns, "size(_cells) AS n_cells_spanned", "size(filter(_seen, n -> n = 0)) AS n_cells_missing",
                               "array_min(_seen) AS n_visits_min", "array_max(_seen) AS n_visits_max")
    ratio = "CASE WHEN n_visits_min > 0 THEN n_visits_max / n_visits_min ELSE double('Infinity') END"
    return named.withColumn("cell_depth_ratio", F.expr(ratio))


def off_grid(stamps: DataFrame, built: DataFrame, size: int) -> DataFrame:
    """Stamps that cover a cell which was never built (`built` holds a row per built cell)."""
    cells = built.select(*COADD, "cell_i", "cell_j").distinct().withColumn("n_visits", F.lit(1).cast("bigint"))
    return with_depth(stamps, cells, size).where("n_cells_missing > 0").select(*stamps.columns)


def covered_known_cells(stamps: DataFrame, visits: DataFrame, size: int) -> DataFrame:
    """(stamp columns, cell) for the covered cells that the contributions know."""
    cells = stamps.withColumn("_c", F.explode(covered_cells(size)))
    cells = cells.select(*stamps.columns, F.col("_c.i").alias("cell_i"), F.col("_c.j").alias("cell_j"))
    known = visits.select(*COADD, F.col("cell_i").cast("bigint").alias("cell_i"), F.col("cell_j").cast("bigint").alias("cell_j"))
    return cells.join(known, [*COADD, "cell_i", "cell_j"], "left_semi")


def check_cell_convention(stamps: DataFrame, visits: DataFrame, size: int) -> None:
    """Fail when no covered cell is in the contributions: the two indices are transposed."""
    if covered_known_cells(stamps, visits, size).isEmpty():
        raise RuntimeError("no cell any stamp covers is in the contributions; the cell indices are transposed")


def walk_order(hosts: DataFrame, seed) -> DataFrame:
    """Add `shuffle` and `patch_rank`. The walk goes by (patch_rank, shuffle, objectId).

    Patches are ranked by the first of their hosts in a seeded shuffle, so whole patches are
    walked together and where the set is drawn from does not change.
    """
    shuffled = hosts.withColumn("shuffle", draw(seed, "objectId"))
    patches = shuffled.groupBy("tract", "patch").agg(F.min(F.struct("shuffle", "objectId")).alias("first"))
    ranked = global_row_number(patches.select("tract", "patch", "first.*"), "shuffle", "objectId", name="patch_rank")
    # A patch holds most of what a task would read, so the ranks go to the hosts.
    return shuffled.join(sendable(ranked.select("tract", "patch", "patch_rank")), ["tract", "patch"])


WALK = ("patch_rank", "shuffle", "objectId")


def part(walk: DataFrame, k: int, n: int) -> DataFrame:
    """Part k of n: whole patches only."""
    if not 0 <= k < n:
        raise ValueError(f"part {k} of {n} does not exist")
    mine = walk.where(F.pmod("patch_rank", F.lit(n)) == k)
    if mine.isEmpty():
        raise ValueError(f"part {k} of {n} has no hosts: there are fewer patches than parts")
    return mine


def part_target(n_stamps: int, n: int) -> int:
    return -(-n_stamps // n)


def walk_until(walk: DataFrame, accepted: DataFrame, n: int | None) -> DataFrame:
    """Hosts walked before the target is met: fewer than n stamps were accepted before them.

    `accepted` is (objectId, n_accepted). Adds `accepted_before` and `n_accepted`.
    """
    counted = walk.select(*WALK).join(accepted, "objectId", "left")
    counted = counted.withColumn("n_accepted", F.coalesce("n_accepted", F.lit(0)))
    summed = global_prefix_sum(counted, *WALK, value="n_accepted", name="accepted_before")
    summed = summed.select("objectId", "n_accepted", "accepted_before")
    out = walk.join(summed, "objectId")
    return out if n is None else out.where(F.col("accepted_before") < n)


def check_walk(walk: DataFrame, read: DataFrame, first: int = GUARD_HOSTS) -> DataFrame:
    """The first walked hosts that gave a stamp; fails when neither they nor any later host gave one, or there are no hosts at all.

    `read` covers the whole walk: a large patch holds all the first hosts, and one without coadds proves nothing.
    A walk of no more than `first` hosts is too short to judge.
    """
    early = walk.orderBy(*WALK).limit(first + 1)
    marked = early.join(read.select("objectId", F.lit(1).alias("_read")).distinct(), "objectId", "left")
    rows = marked.select(*WALK, F.col("_read").isNotNull().alias("read")).orderBy(*WALK).collect()
    if not rows:
        raise RuntimeError("the host catalogue is empty; loosen the cuts")
    good = [r["objectId"] for r in rows[:first] if r["read"]]
    if len(rows) > first and not good and walk.join(read.select("objectId"), "objectId", "left_semi").isEmpty():
        raise RuntimeError(f"neither the first {first} hosts nor any after them gave a stamp; the two patch numberings disagree")
    return walk.where(F.col("objectId").isin(good))


def check_parts(parts: Sequence[DataFrame], walk: DataFrame) -> DataFrame:
    """(problem, tract, patch): patches in two parts, or in none. Empty when the parts are sound."""
    # A few rows a task and part: repeats go where they are read, no host is moved.
    listed = [p.select("tract", "patch").distinct().withColumn("_n", F.lit(1)) for p in parts]
    walked = walk.select("tract", "patch").distinct().withColumn("_n", F.lit(0))
    told = reduce(DataFrame.unionAll, listed, walked).groupBy("tract", "patch").agg(F.sum("_n").alias("_parts"))
    problem = F.when(F.col("_parts") > 1, "in two parts").when(F.col("_parts") == 0, "in no part")
    return told.select("tract", "patch", problem.alias("problem")).where("problem IS NOT NULL")
