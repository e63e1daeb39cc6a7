"""Milliseconds a stamp at real size: python tools/stamp_rate.py [stamps] [native_size]

Builds noise stamps with a host in a scratch Parquet folder, then times whole-set jobs on them.
"""

from __future__ import annotations

import json
import sys
import tempfile
import time
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def main(n: int = 256, size: int = 512) -> None:
    import pandas as pd
    from pyspark.sql import SparkSession, functions as F

    from stampmill.cuts import PatchSettings, TransformSettings
    from stampmill.operators import gate as g, images as im, measure as me, spectra as sp

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    def make(batches):
        y, x = np.mgrid[0:size, 0:size] - size // 2
        for batch in batches:
            for i in batch["id"]:
                rng = np.random.default_rng(int(i))
                image = rng.normal(0, 10, (size, size)) + 400 * np.exp(-(x**2 + y**2) / 800)
                yield pd.DataFrame({"host_id": [i], "image": [image.astype(np.float32).ravel()], "variance": [np.full(size * size, 100, np.float32)],
                                    "mask": [(rng.random(size * size) < 1e-4).astype(np.int64)]})

    path = tempfile.mkdtemp(prefix="stamps-") + "/stamps"
    rows = spark.range(0, n, 1, 32).mapInPandas(make, "host_id long, image array<float>, variance array<float>, mask array<long>")
    planes = F.create_map(*[F.lit(v) for pair in {"SATURATED": 0, "COSMIC_RAY": 1, "INTERPOLATED": 2, "DETECTION_EDGE": 3}.items() for v in pair])
    rows.withColumns({"planes": planes, "n_visits_min": F.lit(9), "cell_depth_ratio": F.lit(1.0), "sky_noise": F.lit(10.0)}).write.parquet(path)
    stamps = spark.read.parquet(path)
    patch, cfg = PatchSettings(native_size=size, out_size=size // 4), TransformSettings(softening=5.0, pooled_noise_ratio=1.0)
    jobs = {
        "read": stamps.select("image"),
        "gate": g.gate(stamps).drop("image", "variance", "mask"),
        "make_batch": im.make_batch(stamps, cfg, patch, "host_id", augment=True),
        "band_power": sp.band_power(stamps),
        "autocorrelation": sp.autocorrelation(sp.power_state(stamps, size)),
        "pixel_stats": stamps.select(F.explode("image").alias("v")).agg(F.avg("v"), F.stddev_pop("v"), F.min("v"), F.max("v")),
        "pooled_noise": im.to_grid(stamps, patch, "host_id").select(me.faint_spread(F.col("image")).alias("s")),
    }
    out = {}
    for name, df in jobs.items():
        times = []
        for _ in range(2):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        out[name] = round(1000 * times[-1] / n, 3)
    print(json.dumps({"stamps": n, "native_size": size, "cores": 8, "wall_ms_per_stamp": out}))
    spark.stop()


if __name__ == "__main__":
    main(*map(int, sys.argv[1:]))
