"""Summaries over the manifest: one row per attempt, accepted or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stampmill.cuts import BANDS, PatchSettings
from stampmill.functions.flux import finite, flux_to_mag
from stampmill.operators.keyed import keep
from stampmill.operators.quantiles import exact_quantiles

# The gated diagnostics and the percentiles reported for them.
DIAGNOSTICS = (
    "centre_sigma",
    "n_peaks",
    "cell_depth_ratio",
    "variance_step",
    "frac_no_data",
    "inner_frac_no_data",
    "frac_COSMIC_RAY",
    "inner_frac_COSMIC_RAY",
    "frac_INTERPOLATED",
    "inner_frac_INTERPOLATED",
    "frac_SATURATED",
    "inner_frac_SATURATED",
)
PERCENTILES = (5, 25, 50, 75, 90, 95, 99)


def rejection_counts(manifest: DataFrame) -> DataFrame:
    """Rejected rows per reason: every reason of a row counts, once per row."""
    rejected = manifest.where(F.coalesce(F.col("status"), F.lit("")) != "accepted")
    parts = F.split(F.coalesce(F.col("reasons"), F.lit("unknown")), ";")
    names = F.array_distinct(
        F.filter(F.transform(parts, lambda p: F.split_part(p, F.lit(":"), F.lit(1))), lambda n: (n != "") & (n != "nan"))
    )
    counted = rejected.select(F.explode(names).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "reason")


def diagnostic_percentiles(manifest: DataFrame) -> DataFrame:
    """Percentiles of each gated diagnostic over every attempt with a finite value; two or more."""
    have = [d for d in DIAGNOSTICS if f"diag_{d}" in manifest.columns]
    pairs = F.array(*[F.struct(F.lit(d).alias("diagnostic"), F.col(f"diag_{d}").cast("double").alias("value")) for d in have])
    long = manifest.select(F.inline(pairs))
    found = exact_quantiles(long, "value", [p / 100 for p in PERCENTILES], by=["diagnostic"], keep=True)
    return found.where("n >= 2").select(
        "diagnostic", "n", *[F.element_at("q", i + 1).alias(f"p{p}") for i, p in enumerate(PERCENTILES)]
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """n, min, quartiles and max of a column."""
    found = exact_quantiles(df, column, (0.0, 0.25, 0.5, 0.75, 1.0), keep=True)
    return found.where("n > 0").select(
        "n", *[F.element_at("q", i + 1).alias(name) for i, name in enumerate(("min", "p25", "p50", "p75", "max"))]
    )


def visits_per_cell(attempts: DataFrame, visits: DataFrame) -> DataFrame:
    """`distribution` of visits over the cells of all coadds read, each coadd once."""
    read = attempts.where("was_read").select("tract", "patch", "band_idx").distinct()
    return distribution(visits.join(read, ["tract", "patch", "band_idx"], "left_semi"), "n_visits")


def run_counts(n_candidates: int | None, manifest: DataFrame, requested: int | None = None, rows_per_file: int | None = None) -> DataFrame:
    """One row of run counters from the manifest.

    A host is off the grid when it has coadds and none of its stamps was read. With `rows_per_file`
    the files of the stamp set are counted too.
    """
    reason = F.coalesce(F.split_part(F.col("reasons"), F.lit(":"), F.lit(1)), F.lit(""))
    status = manifest.withColumn("_no_coadd", reason == "no_coadd").withColumn("_off", reason == "off_the_grid")
    hosts = status.groupBy("host_id").agg(
        F.max("_no_coadd").alias("no_coadd"),
        F.min("_off").alias("off"),
        F.count_if("_off").alias("stamps_off"),
        F.count(F.lit(1)).alias("attempts"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
    )
    out = hosts.agg(
        F.count(F.lit(1)).alias("hosts_tried"),
        F.count_if("no_coadd").alias("hosts_with_no_coadd"),
        F.count_if("off").alias("hosts_off_the_grid"),
        F.coalesce(F.sum("stamps_off"), F.lit(0)).alias("stamps_off_the_grid"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("stamps_attempted"),
        F.coalesce(F.sum("accepted"), F.lit(0)).alias("stamps_accepted"),
    )
    files = [] if rows_per_file is None else [F.ceil(F.col("stamps_accepted") / rows_per_file).alias("files")]
    return out.select(
        F.lit(n_candidates).cast("bigint").alias("host_candidates"),
        "*",
        (F.col("stamps_attempted") - F.col("stamps_accepted")).alias("stamps_rejected"),
        F.lit(requested).cast("bigint").alias("stamps_requested"),
        *files,
    )


def run_summary(manifest: DataFrame, part: int = 0, n_candidates: int | None = None, requested: int | None = None, labels: dict[str, str] | None = None) -> DataFrame:
    """(part, block, name, value): the counters of one run, as text, in the form that merging parts adds up.

    Counts that are not known are left out; `labels` are text entries such as the data set's name.
    """
    counts = run_counts(n_candidates, manifest, requested)
    told = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in counts.columns])
    rows = counts.select(F.lit("counts").alias("block"), F.inline(told)).where("value IS NOT NULL")
    reasons = rejection_counts(manifest).select(F.lit("rejection_counts").alias("block"), F.col("reason").alias("name"), F.col("n").cast("string").alias("value"))
    said = manifest.sparkSession.createDataFrame([("counts", k, v) for k, v in {"part": str(part), **(labels or {})}.items()], "block string, name string, value string")
    return rows.unionByName(reasons).unionByName(said).select(F.lit(part).alias("part"), "block", "name", "value")


def shortfall(counts: DataFrame) -> DataFrame:
    """A warning row when fewer stamps were accepted than asked for; no row otherwise."""
    text = F.format_string("accepted %d of the %d stamps asked for after all %d hosts; loosen the cuts",
                           "stamps_accepted", "stamps_requested", "hosts_tried")
    return counts.where("stamps_accepted < stamps_requested").select("stamps_requested", "stamps_accepted", text.alias("warning"))


def first_failures(manifest: DataFrame) -> DataFrame:
    """The earliest failure message of each kind, in walk order."""
    off = manifest.where(F.col("reasons").startswith("off_the_grid:"))
    kind = F.split_part(F.col("reasons"), F.lit(":"), F.lit(2))
    return off.groupBy(kind.alias("kind")).agg(
        F.min_by("message", F.struct("walk_index", "band_idx")).alias("message"), F.count(F.lit(1)).alias("n")
    )


def histogram(df: DataFrame, value: str, bins: int | Column, group: str | None = None, panel: str | None = None) -> DataFrame:
    """Counts on equal-width bins shared by all groups of a panel; the maximum is in the last bin.

    A panel of one single value gets the unit-wide range around it, as numpy does.
    """
    keys = [panel] if panel else []
    values = df.where(finite(F.col(value))).select(*keys, *([group] if group else []), F.col(value).cast("double").alias("_v"),
                                                   (F.lit(bins) if isinstance(bins, int) else bins).alias("_bins"))
    edges = values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    edges = edges.select(
        *keys,
        F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"),
        F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"),
    )
    if keys:
        joined = values.join(F.broadcast(edges), keys)
    else:
        low = edges.first()
        joined = values.withColumn("_lo", F.lit(low["_lo"])).withColumn("_hi", F.lit(low["_hi"]))
    place = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_bins"))
    binned = joined.withColumn("bin", F.least(place, F.col("_bins") - 1).cast("int"))
    return binned.groupBy(*keys, *([group] if group else []), "bin").agg(F.count(F.lit(1)).alias("n"))


def host_panels(hosts: DataFrame, meta: DataFrame, band: str = "r") -> DataFrame:
    """(panel, value, bins): the host and stamp quantities whose histograms describe the set."""
    from stampmill.operators.hosts import distortion, mean_surface_brightness

    def long(df, panels):
        rows = [F.struct(F.lit(p).alias("panel"), v.cast("double").alias("value"), F.lit(b).alias("bins")) for p, v, b in panels]
        return df.select(F.inline(F.array(*rows)))

    flux = F.col(f"{band}_cModelFlux")
    from_hosts = [
        ("host size", F.col("sersic_reff_major"), 40),
        ("host distortion", distortion(), 40),
        ("host magnitude", flux_to_mag(flux), 40),
        ("host surface brightness", mean_surface_brightness(band), 40),
        ("host Sersic index", F.col("sersic_index"), 40),
        ("host blendedness", F.col(f"{band}_blendedness"), 40),
    ]
    from_meta = [
        ("local sky noise", F.col("sky_noise"), 40),
        ("variance step", F.col("variance_step"), 40),
        ("visits in shallowest cell", F.when(F.col("n_visits_min") > 0, F.col("n_visits_min")), 30),
        ("coadd cells spanned", F.col("n_cells_spanned"), 20),
        ("no-data fraction", F.col("frac_no_data"), 40),
        ("INEXACT_PSF fraction", F.col("frac_inexact_psf"), 40),
        ("REJECTED fraction", F.col("frac_rejected"), 40),
    ]
    return long(hosts, from_hosts).unionByName(long(meta, from_meta))


def host_population(hosts: DataFrame, meta: DataFrame, band: str = "r") -> DataFrame:
    """Histogram rows (panel, bin, n) for every panel of `host_panels`."""
    return histogram(host_panels(hosts, meta, band), "value", F.col("bins"), panel="panel")


def band_counts(df: DataFrame) -> DataFrame:
    """Stamps per band over the whole band list, zero for absent bands."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(BANDS)], "band_idx int, band string")
    counted = df.groupBy(F.col("band_idx").cast("int").alias("band_idx")).agg(F.count(F.lit(1)).alias("n"))
    return bands.join(counted, "band_idx", "left").select("band_idx", "band", F.coalesce("n", F.lit(0)).alias("n"))


def top_k(df: DataFrame, k: int, by: str, key: str) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(k)


def manifest_cut(stamps: DataFrame, manifest: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Stamps whose accepted manifest row is within each limit, joined on (host_id, band).

    The last of several manifest rows of a stamp counts, in `manifest_index` order. A stamp
    without an accepted row, or a missing column, is an error.
    """
    limits = {c: v for c, v in limits.items() if v is not None}
    if not limits:
        return stamps
    missing = [c for c in limits if c not in manifest.columns]
    if missing:
        raise ValueError(f"the manifest has no {missing}")
    accepted = manifest.where(F.col("status") == "accepted") if "status" in manifest.columns else manifest
    last = accepted.groupBy("host_id", "band").agg(
        F.max_by(F.struct(*limits), "manifest_index").alias("_m")
    )
    keys = band_name(stamps.select("host_id", "band_idx"))
    joined = keys.join(last, ["host_id", "band"], "left")
    lost = F.raise_error(F.lit("a stamp has no accepted manifest row; the manifest is from another run"))
    within = F.lit(True)
    for column, limit in limits.items():
        value = F.col(f"_m.{column}").cast("double")
        within = within & (value <= limit) & ~F.isnan(value)
    passed = joined.where(F.when(F.col("_m").isNull(), lost.cast("boolean")).otherwise(within))
    # Only keys met the manifest; the images stay where they are when few keys are left.
    return keep(stamps, passed, ["host_id", "band_idx"])


def usable(stamps: DataFrame, patch: PatchSettings, manifest: DataFrame | None = None) -> DataFrame:
    """The stamps a loader may use; batches and statistics are to start from these.

    The no-data cut reads the stamps' own narrow column, the cuts on saturated and interpolated
    pixels the manifest; each has its own switch. A limit on a plane without a manifest, or a
    fraction that is not known, is an error. The images are picked once, by key.
    """
    limits = {"diag_frac_SATURATED": patch.max_frac_saturated, "diag_frac_INTERPOLATED": patch.max_frac_interpolated}
    limits = {c: v for c, v in limits.items() if v is not None}
    if limits and manifest is None:
        raise ValueError(f"{sorted(limits)} are limited, which needs the manifest")
    left = no_data_cut(stamps, patch.max_no_data)
    return manifest_cut(left, manifest, limits) if limits else left


def no_data_cut(df: DataFrame, max_no_data: float | None) -> DataFrame:
    """Keep `frac_no_data <= max_no_data`; a row that does not know its fraction is an error."""
    if max_no_data is None or max_no_data < 0:
        return df
    frac = F.col("frac_no_data").cast("double")
    known = finite(frac) & (frac >= 0)
    unknown = F.raise_error(F.lit("a stamp carries no frac_no_data, so the no-data cut cannot be applied"))
    return df.where(F.when(known, frac <= max_no_data).otherwise(unknown.cast("boolean")))


def band_name(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(b) for b in BANDS])
    index = F.col("band_idx")
    known = index.between(0, len(BANDS) - 1)
    name = F.when(known, F.get(names, index.cast("int"))).otherwise(
        F.raise_error(F.concat(F.lit("unknown band index "), index.cast("string")))
    )
    return df.withColumn("band", name)


def band_index(df: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(b) for b in BANDS])
    place = F.array_position(names, F.col("band"))
    unknown = F.raise_error(F.concat(F.lit("unknown band "), F.col("band"))).cast("int")
    return df.withColumn("band_idx", F.when(place > 0, (place - 1).cast("int")).otherwise(unknown))


def set_report(df: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows, image bytes, and rows the cuts held back."""
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(4 * F.size("image").cast("bigint")), F.lit(0)).alias("image_bytes"))
    row, n_kept = whole.first(), kept.count()
    return df.sparkSession.createDataFrame(
        [(row["n"], row["image_bytes"], n_kept, row["n"] - n_kept)],
        "n_rows bigint, image_bytes bigint, n_kept bigint, n_held_back bigint",
    )
