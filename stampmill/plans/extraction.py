"""Extraction as one job: hosts, coadds, depth, pixels, gate, stop at the target.

The gate is the costly step and the walk stops early, so whole patches are taken in ranges of walk
rank, each sized by the hosts still needed at the acceptance seen so far, until enough stamps are
accepted; the exact stop is then applied to the whole. A range never has more hosts than their keys
can be sent to the pixel table, so images are not shuffled, and each range is checked as it ends.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from stampmill.cuts import BANDS, PatchCuts
from stampmill.operators.gate import gate
from stampmill.operators.hosts import data_id_json, stamp_box, verify_centre
from stampmill.operators.keyed import BROADCAST_KEYS, fetch
from stampmill.operators.lineage import settle
from stampmill.operators.ordering import global_prefix_sum
from stampmill.operators import walk as w
from stampmill.sources.pixels import LAYOUT, from_patches

FIRST_ACCEPTANCE, MARGIN = 0.25, 1.2


@dataclass
class Extraction:
    manifest: DataFrame  # one row per attempt, patch_index on the accepted ones
    hosts: DataFrame  # hosts walked
    stamps: DataFrame  # accepted images with their 18 metadata columns
    target: int | None
    short: bool  # the catalogue ran out before the target


def attempt(walk: DataFrame, coadds, visits, pixels, cuts: PatchCuts, bands: Sequence[str], size: int, whole: DataFrame | None = None) -> DataFrame:
    """A manifest row for each host and band of a piece of the walk (`whole`), without the images."""
    none = w.hosts_without_coadd(walk, coadds, bands).withColumn("reasons", F.lit("no_coadd"))
    tried = w.with_depth(w.host_coadds(walk, coadds, bands), visits, size)
    if {"got_ra", "got_dec"} <= set(tried.columns):
        tried = verify_centre(tried)
    tried = data_id_json(tried, ("tract", "patch", "band"))
    tried = settle(stamp_box(tried, size).withColumnRenamed("objectId", "host_id"))
    if not tried.isEmpty() and tried.where("n_cells_missing < n_cells_spanned").isEmpty():
        # One piece may lie outside; that all do is for the whole walk to tell.
        w.check_cell_convention(w.host_coadds(walk if whole is None else whole, coadds, bands), visits, size)
    # Rows that do not fit are settled before any pixel is fetched.
    fits = tried.where("n_cells_missing = 0")
    outside = tried.where("n_cells_missing > 0").withColumns(
        {"reasons": F.lit("off_the_grid:cells"),
         "message": F.concat(F.col("n_cells_missing").cast("string"), F.lit(" cells were never built"))})

    on = [c for c in (*LAYOUT, "host_id", "band_idx") if c in pixels.columns]
    found = from_patches(pixels, fits.select(*on, "n_visits_min", "cell_depth_ratio"))
    whole = (F.col("native_size") == size) & (F.size("image") == size * size)
    for column in ("image", "variance", "mask"):
        found = found.withColumn(column, F.when(whole, F.col(column)))
    judged = gate(found, cuts)
    shape = F.format_string("clipped:(%d, %d)", F.col("native_size"), F.col("native_size"))
    judged = judged.select(
        "host_id", "band_idx", F.lit(True).alias("was_read"),
        F.when(F.col("image").isNull(), shape).otherwise(F.concat_ws(";", "reasons")).alias("reasons"),
        F.to_json(F.map_from_entries(F.array_sort(F.map_entries("planes")))).alias("plane_map"),
        *[c for c in judged.columns if c.startswith("diag_")],
    )
    # What the pixel table did not have shows in the same join.
    rows = fits.join(judged, ["host_id", "band_idx"], "left").withColumns(
        {"message": F.when(F.col("was_read").isNull(), F.lit("no pixels")),
         "reasons": F.when(F.col("was_read").isNull(), F.lit("off_the_grid:read")).otherwise(F.col("reasons")),
         "was_read": F.coalesce("was_read", F.lit(False))})
    for other in (none.withColumnRenamed("objectId", "host_id"), outside):
        rows = rows.unionByName(other.withColumn("was_read", F.lit(False)), allowMissingColumns=True)
    return rows.withColumn("status", F.when(F.col("reasons") == "", "accepted").otherwise("rejected"))


def readable(walk: DataFrame, coadds, visits, pixels, bands: Sequence[str], size: int) -> DataFrame:
    """objectId of the hosts with a stamp on the grid that the pixel table has. Reads keys only."""
    tried = w.with_depth(w.host_coadds(walk, coadds, bands), visits, size).where("n_cells_missing = 0").withColumnRenamed("objectId", "host_id")
    on = [c for c in (*LAYOUT, "host_id", "band_idx") if c in pixels.columns]
    return tried.join(pixels.select(*on), on, "left_semi").select(F.col("host_id").alias("objectId"))


def extract(hosts, coadds, contributions, pixels, *, size: int, cuts: PatchCuts | None = None, bands: Sequence[str] = BANDS,
            seed=0, n_stamps: int | None = None, part: tuple[int, int] | None = None) -> Extraction:
    """`pixels` has host_id, band_idx, native_size, image, variance, mask and planes, and tract and patch if `write_pixels` laid it out."""
    cuts = cuts or PatchCuts()
    walk = w.walk_order(hosts, seed)
    target = n_stamps
    if part is not None:
        walk = w.part(walk, *part)
        target = None if n_stamps is None else w.part_target(n_stamps, part[1])
    walk = settle(walk)
    visits = settle(w.cell_visit_counts(contributions))
    sizes = walk.groupBy("patch_rank").agg(F.count(F.lit(1)).alias("n"))
    sizes = global_prefix_sum(sizes, "patch_rank", value="n", name="before")
    last = sizes.agg(F.max("patch_rank")).first()[0]
    if last is None:
        raise RuntimeError("the host catalogue is empty; loosen the cuts")

    rows, low, walked_hosts, accepted, plane_map, guarded = None, 0, 0, 0, None, False
    most = max(1, BROADCAST_KEYS // len(bands))
    while low <= last and (target is None or accepted < target):
        step = most
        if target is not None:
            # Without any acceptance so far the next range doubles what was walked in vain.
            rate = accepted / walked_hosts if accepted else FIRST_ACCEPTANCE * len(bands)
            step = max(math.ceil(MARGIN * (target - accepted) / rate), 1)
            step = min(step if accepted else max(step, 2 * walked_hosts), most)
        edge = sizes.where(F.col("before") + F.col("n") >= walked_hosts + step).agg(F.min("patch_rank")).first()[0]
        high = last + 1 if edge is None else max(edge, low) + 1
        piece = walk.where(F.col("patch_rank").between(low, high - 1))
        done = settle(attempt(piece, coadds, visits, pixels, cuts, bands, size, walk).withColumnRenamed("host_id", "objectId"))
        seen = done.agg(
            F.count_if(F.col("status") == "accepted").alias("a"), F.countDistinct("objectId").alias("h"), F.count_if("was_read").alias("r"),
            F.min("plane_map").alias("first"), F.max("plane_map").alias("last")).first()
        accepted, walked_hosts = accepted + seen["a"], walked_hosts + seen["h"]
        for found in (seen["first"], seen["last"]):
            if found is not None and found != (plane_map or found):
                raise RuntimeError(f"the mask plane map changed between stamps: {plane_map} and {found}")
            plane_map = plane_map or found
        rows = done if rows is None else rows.unionByName(done, allowMissingColumns=True)
        if not guarded and not seen["r"] and walked_hosts > w.GUARD_HOSTS:
            w.check_walk(walk, readable(walk, coadds, visits, pixels, bands, size))
        guarded = guarded or bool(seen["r"]) or walked_hosts > w.GUARD_HOSTS
        low = high

    # One running count of accepted stamps in walk order gives each its number, and each host the
    # count before it: the host is walked while that is under the target.
    taken = (F.col("status") == "accepted").cast("bigint")
    keys = rows.select(*w.WALK, F.coalesce("band_idx", F.lit(-1)).alias("_band"), taken.alias("_taken"))
    numbered = global_prefix_sum(keys, *w.WALK, "_band", value="_taken", name="patch_index")
    before = numbered.groupBy("objectId").agg(F.min("patch_index").alias("accepted_before"))
    if target is not None:
        before = before.where(F.col("accepted_before") < target)
    walked = walk.join(before, "objectId")
    manifest = (
        rows.withColumn("_band", F.coalesce("band_idx", F.lit(-1)))
        .join(numbered.select("objectId", "_band", "patch_index"), ["objectId", "_band"])
        .join(before.select("objectId"), "objectId", "left_semi")
        .withColumn("patch_index", F.when(F.col("status") == "accepted", F.col("patch_index")))
        .withColumn("band", F.coalesce("band", F.lit("")))
        .withColumnRenamed("objectId", "host_id")
        .drop("_band", "plane_map")
    )
    manifest = settle(manifest)
    return Extraction(manifest, walked, accepted_stamps(manifest, pixels, size), target, target is not None and accepted < target)


def accepted_stamps(manifest: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Accepted images with their metadata, read again by key rather than carried along."""
    origin = F.when(F.col("x0").isNull() | F.col("y0").isNull(), F.raise_error(F.lit("a stamp has no origin")).cast("boolean")).otherwise(True)
    meta = manifest.where("status = 'accepted'").where(origin).select(
        "patch_index", "host_id", "band_idx",
        F.col("x0").cast("int").alias("x0"), F.col("y0").cast("int").alias("y0"),
        F.col("coord_ra").alias("ra"), F.col("coord_dec").alias("dec"),
        (F.col("pixel_scale") if "pixel_scale" in manifest.columns else F.lit(float("nan"))).cast("float").alias("pixel_scale"),
        F.col("diag_sky_noise").cast("float").alias("sky_noise"), "tract", "patch",
        *[F.col(c).cast("smallint").alias(c) for c in ("n_cells_spanned", "n_visits_min", "n_visits_max")],
        F.col("diag_cell_depth_ratio").cast("float").alias("cell_depth_ratio"),
        F.col("diag_variance_step").cast("float").alias("variance_step"),
        F.col("diag_frac_no_data").cast("float").alias("frac_no_data"),
        F.col("diag_frac_INEXACT_PSF").cast("float").alias("frac_inexact_psf"),
        F.col("diag_frac_REJECTED").cast("float").alias("frac_rejected"),
    )
    # A pixel table laid out by patch is pruned by it as long as the keys can be sent.
    on = [c for c in (*LAYOUT, "host_id", "band_idx") if c in pixels.columns]
    return fetch(pixels.select(*on, "image", "native_size"), meta, on)
