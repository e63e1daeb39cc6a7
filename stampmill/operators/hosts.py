"""Host selection from the object catalogue: cuts, flags, geometry and positional dedupe."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from stampmill.cuts import HostCuts
from stampmill.functions.flux import finite, flux_to_mag
from stampmill.operators.lineage import settle

CENTRE_TOLERANCE_ARCSEC = 1.0


def unmask(df: DataFrame) -> DataFrame:
    """Null numbers to their sentinel: NaN for floats, -1 for integers; other types untouched."""
    fills = {}
    for field in df.schema:
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(float("nan")).cast(field.dataType))
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            fills[field.name] = F.coalesce(F.col(field.name), F.lit(-1).cast(field.dataType))
    return df.withColumns(fills) if fills else df


def host_cuts(df: DataFrame, cuts: HostCuts | None = None) -> DataFrame:
    """The numeric cuts, as plain comparisons against constants so they reach the scan.

    Null and NaN pass nothing: a floor is paired with a ceiling, or guarded by `isnan`.
    """
    cuts = cuts or HostCuts()
    flux, size = F.col(f"{cuts.band}_cModelFlux"), F.col("sersic_reff_major")
    faint, bright = cuts.flux_range
    kept = df.where((flux > faint) & (flux <= bright)).where(
        (size >= float(cuts.min_reff_arcsec)) & (size <= float(cuts.max_reff_arcsec))
    )
    if cuts.min_extendedness is not None:
        extended = F.col("refExtendedness")
        kept = kept.where((extended > float(cuts.min_extendedness)) & ~F.isnan(extended))
    if cuts.flux_per_area is not None:
        area = size * F.col("sersic_reff_minor")
        kept = kept.where((flux >= F.lit(cuts.flux_per_area) * area) & ~F.isnan(area))
    if cuts.max_sersic_index is not None:
        kept = kept.where(F.col("sersic_index") <= float(cuts.max_sersic_index))
    if cuts.max_blendedness is not None:
        kept = kept.where(F.col(f"{cuts.band}_blendedness") <= float(cuts.max_blendedness))
    return kept


def cone(df: DataFrame, ra: float, dec: float, radius_deg: float) -> DataFrame:
    """Rows within a radius on the sphere; a declination range goes to the scan first."""
    lat, lat0 = F.radians("coord_dec"), F.lit(math.radians(dec))
    half_dec = F.sin((lat - lat0) / 2)
    half_ra = F.sin((F.radians("coord_ra") - F.lit(math.radians(ra))) / 2)
    hav = half_dec * half_dec + F.cos(lat) * F.lit(math.cos(math.radians(dec))) * half_ra * half_ra
    near = F.degrees(2 * F.asin(F.sqrt(F.least(hav, F.lit(1.0))))) <= radius_deg
    slack = radius_deg * (1 + 1e-9) + 1e-9
    return df.where(F.col("coord_dec").between(dec - slack, dec + slack)).where(near)


def host_flags(df: DataFrame, cuts: HostCuts | None = None) -> DataFrame:
    """Finite position, no failed fit, and no saturated or interpolated core in the cut band."""
    cuts = cuts or HostCuts()
    kept = df.where(finite(F.col("coord_ra")) & finite(F.col("coord_dec")))
    kept = kept.where(~F.col("sersic_unknown_flag") & ~F.col("sersic_no_data_flag"))
    if cuts.reject_saturated_centre:
        kept = kept.where(~F.col(f"{cuts.band}_pixelFlags_saturatedCenter"))
    if cuts.reject_interpolated_centre:
        kept = kept.where(~F.col(f"{cuts.band}_pixelFlags_interpolatedCenter"))
    return kept


def mean_surface_brightness(band: str) -> Column:
    """mag/arcsec^2 inside the half-light ellipse; NaN where it is not defined."""
    area = F.col("sersic_reff_major") * F.col("sersic_reff_minor")
    good = area > 0
    return F.when(
        good & ~F.isnan(area), flux_to_mag(F.col(f"{band}_cModelFlux")) + 2.5 * F.log10(F.when(good, F.lit(2 * math.pi) * area))
    ).otherwise(F.lit(float("nan")))


def axis_ratio() -> Column:
    major = F.col("sersic_reff_major")
    usable = (major > 0) & ~F.isnan(major)
    return F.when(usable, F.col("sersic_reff_minor") / F.when(usable, major)).otherwise(F.lit(float("nan")))


def distortion() -> Column:
    q2 = axis_ratio() * axis_ratio()
    return (1 - q2) / (1 + q2)


def binding_cut(df: DataFrame, cuts: HostCuts | None = None) -> DataFrame:
    """Add the magnitude of the surface-brightness limit at each host's size, and which cut binds."""
    cuts = cuts or HostCuts()
    if cuts.max_mu_e is None:
        return df.withColumn("mag_from_sb", F.lit(None).cast("double")).withColumn("binding", F.lit("magnitude"))
    area = F.col("sersic_reff_major") * F.col("sersic_reff_minor")
    limit = F.lit(cuts.max_mu_e) - 2.5 * F.log10(F.when(area > 0, F.lit(2 * math.pi) * area))
    return df.withColumn("mag_from_sb", limit).withColumn(
        "binding", F.when(F.lit(cuts.max_mag) < F.col("mag_from_sb"), "magnitude").otherwise("surface brightness")
    )


def binding_table(spark: SparkSession, cuts: HostCuts | None = None, sizes=(1.0, 2.0, 4.0, 10.0, 20.0), axis_ratio: float = 0.6) -> DataFrame:
    """`binding_cut` at a few sizes inside the cuts' own range."""
    cuts = cuts or HostCuts()
    rows = [(float(a), axis_ratio * a) for a in sizes if cuts.min_reff_arcsec <= a <= cuts.max_reff_arcsec]
    return binding_cut(spark.createDataFrame(rows, "sersic_reff_major double, sersic_reff_minor double"), cuts)


def separation_arcsec(ra: Column, dec: Column, ra0: Column, dec0: Column) -> Column:
    """Small-angle distance of a position from (ra0, dec0)."""
    return F.hypot((ra - ra0) * F.cos(F.radians(dec0)), dec - dec0) * 3600.0


def verify_centre(df: DataFrame, tolerance: float = CENTRE_TOLERANCE_ARCSEC) -> DataFrame:
    """Add `centre_sep_arcsec`; the job fails on a stamp that is not where it was asked for."""
    sep = separation_arcsec(F.col("got_ra"), F.col("got_dec"), F.col("coord_ra"), F.col("coord_dec"))
    astray = F.raise_error(F.lit("a stamp is not where it was asked for: two pixel origins are mixed")).cast("double")
    return df.withColumn("centre_sep_arcsec", F.when(finite(sep) & (sep <= tolerance), sep).otherwise(astray))


def stamp_box(df: DataFrame, size: int) -> DataFrame:
    """Half-open pixel box of a `size` stamp at (x, y), rounding halves to even."""
    half = size // 2
    x0, y0 = F.bround("x").cast("bigint") - half, F.bround("y").cast("bigint") - half
    return df.withColumns({"x0": x0, "x1": x0 + size, "y0": y0, "y1": y0 + size})


def data_id_json(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumn("data_id", F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns])))


# -- positional dedupe ------------------------------------------------------


_SLACK = 1 + 1e-9


def _cos(dec: str) -> str:
    return f"greatest(cos(radians({dec})), 1e-6)"


def _ra_width(r: float) -> str:
    """Width of a declination band's right-ascension buckets: one radius at the band's widest."""
    edge = f"least(greatest(abs(band * {r!r}D), abs((band + 1) * {r!r}D)), 90D)"
    return f"({r * _SLACK!r}D / {_cos(edge)})"


def _probe(rows: DataFrame, r: float, steps: tuple[int, int], reach: str, wrap: bool) -> DataFrame:
    """Copies of each place in every bucket it can meet: two bands, a few buckets each.

    `reach` is how far the place reaches in right ascension, as an expression of its dec and band.
    """
    turns = "array(0D, 360D, -360D)" if wrap else "array(0D)"
    out = rows.selectExpr("id", "dec", "ra", f"{reach} AS reach", "band AS home", f"explode(array({steps[0]}L, {steps[1]}L)) AS step")
    out = out.selectExpr("id", "dec", "ra", "reach", "home + step AS band", f"explode({turns}) AS turn")
    if wrap:
        out = out.where("turn = 0 OR (ra + turn + reach >= 0 AND ra + turn - reach <= 360)")
    width = _ra_width(r)
    low, high = (f"floor((ra + turn {sign} reach) / {width})" for sign in "-+")
    return out.selectExpr("id", "dec", "ra AS at", "ra + turn AS ra", "band", f"explode(sequence({low}, {high})) AS bucket")


def _near(early: str, late: str, r: float) -> str:
    """`late` is a duplicate of `early`: it comes later, and the cosine is taken at its place."""
    return f"""({early}.dec < {late}.dec OR ({early}.dec = {late}.dec AND {early}.id < {late}.id)) AND {early}.dec >= {late}.dec - {r!r}D
        AND hypot(({early}.ra - {late}.ra) * {_cos(late + '.dec')}, {early}.dec - {late}.dec) < {r!r}D"""


def _same(left: str, right: str) -> str:
    """Two rows stand for the same place. Ids are never compared: they may repeat."""
    return f"{left}.ra <=> {right}.ra AND {left}.dec <=> {right}.dec"


def dedupe(df: DataFrame, radius_arcsec: float = 0.5, wrap: bool = False, key: str = "objectId") -> DataFrame:
    """Walk the rows by (declination, id); drop a row nearer than the radius to a kept one.

    Done in rounds over open places, a place being a position with the first of its ids. The first
    open place of each sky bucket is kept when no earlier open one is near it; then every open place
    near a newly kept one is dropped. Each bucket puts forward one place a round and a bucket one
    radius wide keeps only a few ever, so the pairs formed are a small multiple of the open places,
    however many share a bucket. Of rows at exactly one position one is kept, of equal ids any one.
    Buckets are joined by key, so a crowded one can be split by the skew-join rule.
    """
    r = radius_arcsec / 3600.0
    if not r > 0:
        return df
    places = df.selectExpr("coord_ra AS ra", "coord_dec AS dec", f"`{key}` AS id").groupBy("ra", "dec").agg(F.expr("min(id) AS id"))
    placed = places.selectExpr("id", "ra", "dec", f"floor(dec / {r!r}D) AS band")
    open_rows = settle(placed.selectExpr("*", f"floor(ra / {_ra_width(r)}) AS bucket"))
    kept, left = None, open_rows.count()
    while left:
        first = open_rows.groupBy("band", "bucket").agg(F.expr("min(struct(dec, id, ra)) AS m")).select("m.*", "band", "bucket")
        asked = _probe(first, r, (0, -1), f"({r * _SLACK!r}D / {_cos('dec')})", wrap)
        at = "{0}.band = o.band AND {0}.bucket = o.bucket AND "
        blocked = asked.alias("a").join(open_rows.alias("o"), F.expr(at.format("a") + _near("o", "a", r))).selectExpr("a.at AS ra", "a.dec AS dec").distinct()
        new = settle(first.alias("f").join(blocked.alias("b"), F.expr(_same("f", "b")), "left_anti"))
        kept = new.select("id", "ra", "dec") if kept is None else kept.union(new.select("id", "ra", "dec"))
        # A kept place reaches places of its own band and the next, at the widest either can be.
        widest = f"least(greatest(abs(dec), abs((band + 2) * {r!r}D)), 90D)"
        reach = _probe(new, r, (0, 1), f"({r * _SLACK!r}D / {_cos(widest)})", wrap)
        open_rows = settle(
            open_rows.alias("o")
            .join(reach.alias("k"), F.expr(at.format("k") + _near("k", "o", r)), "left_anti")
            .join(new.select("ra", "dec").alias("n"), F.expr(_same("o", "n")), "left_anti")
        )
        left = open_rows.count()
    if kept is None:
        return df
    found = df.alias("d").join(kept.alias("k"), F.expr(f"d.coord_ra <=> k.ra AND d.coord_dec <=> k.dec AND d.`{key}` <=> k.id"), "left_semi")
    return found.dropDuplicates(["coord_ra", "coord_dec", key])


def select_hosts(df: DataFrame, cuts: HostCuts | None = None) -> DataFrame:
    """Numeric cuts, flags, dedupe."""
    cuts = cuts or HostCuts()
    return dedupe(host_flags(host_cuts(df, cuts), cuts), cuts.dedupe_radius_arcsec)
