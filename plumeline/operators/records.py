"""Records around a case: defaults, sealed properties, placeholders, field figures, provenance, masks and comparisons."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..sources.staging import staged
from .image import closed, ellipse  # noqa: F401 - ellipse is part of this module's interface
from .masks import over_tiles
from .regions import labelled, region_figures

# The properties of a reference slick that may be kept; all others describe its source.
KEPT_PROPERTIES = ("id", "slick_timestamp", "s1_scene_id", "length", "area", "perimeter", "machine_confidence", "polsby_popper", "fill_factor", "linearity")
#: Decibels that an 8-bit scene spans where its bounds don't say.
DB_CLAMP = {"db_min": -25.0, "db_max": 0.0}
MATCH_KM, KM_PER_DEG = 1.0, 111.32


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing columns and null values take their defaults."""
    return df.withColumns({c: F.coalesce(df[c], F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def merged_calibration(loaded: Column, defaults: dict[str, float]) -> Column:
    """A map of weights: the loaded ones over the defaults, further ones kept; null loads nothing."""
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv))
    return F.map_zip_with(base, F.coalesce(loaded, F.create_map().cast("map<string,double>")), lambda _, a, b: F.coalesce(b, a))


def sealed_properties(features: DataFrame, body: str = "properties") -> DataFrame:
    """A JSON object of properties cut down to the ones that may be kept, each a column of text; absent ones are null."""
    return features.select(*(c for c in features.columns if c != body), *(F.get_json_object(body, f"$.{k}").alias(f"kept_{k}") for k in KEPT_PROPERTIES))


def placeholders(documents: DataFrame, body: str = "body", mark: str = "TODO") -> DataFrame:
    """(other columns, path) of every text in nested JSON that still holds the mark; keys with a leading underscore are notes.

    Documents are opened level by level: the values of a level are rows, of which texts are judged and
    objects and arrays make the rows of the next. A level is a written table. Null documents and those
    that are no JSON have no rows; a column named path is replaced.
    """
    others = [c for c in documents.columns if c not in (body, "path")]
    level = documents.select(F.struct(*(documents[c] for c in others), F.lit(0).alias("_")).alias("row"), F.lit("").alias("path"), F.try_parse_json(documents[body]).alias("node"))
    found = None
    while True:
        level = staged(level.where("node is not null").withColumn("kind", F.schema_of_variant("node")), "level")
        texts = level.where((F.col("kind") == "STRING") & F.contains(F.variant_get("node", "$", "string"), F.lit(mark))).select("row", "path")
        found = texts if found is None else found.union(texts)
        nested = level.where(F.col("kind").startswith("OBJECT") | F.col("kind").startswith("ARRAY"))
        if nested.isEmpty():
            return found.select(*(F.col("row")[c].alias(c) for c in others), "path")
        inner = nested.lateralJoin(nested.sparkSession.tvf.variant_explode(F.col("node").outer()))
        place = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("path", F.when(F.col("path") == "", "").otherwise("."), "key"))
        level = inner.where("key is null or not startswith(key, '_')").select("row", place.alias("path"), F.col("value").alias("node"))


def limited(hits: DataFrame, client: str = "client", at: str = "at_s", most: int = 5, window_s: float = 60.0) -> DataFrame:
    """hits with `accepted`: a client's hit passes if fewer than `most` accepted ones lie within the last seconds.

    A client's hits fall into spells: where a whole window passes without a hit, nothing before it counts
    any more, so spells go to tasks on their own. They are found on the client's occupied windows, not on
    its hits. Inside a spell, after `most` accepted hits, the next to pass is the first one later than the window
    after the `most`-th last, found by bisection; refused hits are skipped.

    Null is a client of its own. Hits at one time go by their other columns' order. A hit without a time
    is neither accepted nor refused: null. A column named accepted is replaced.
    """
    names = [c for c in hits.columns if c != "accepted"]
    rows = hits.select(F.struct(*(hits[c] for c in names)).alias("row"), hits[client].alias("who"), hits[at].cast("double").alias("t"))
    rows = rows.withColumn("w", F.floor(F.col("t") / F.lit(float(window_s))))
    order = Window.partitionBy("who").orderBy("w")
    busy = rows.where("w is not null").select("who", "w").distinct().withColumn("new", F.coalesce(F.col("w") - F.lag("w").over(order) > 1, F.lit(True)))
    spells = busy.select(F.col("who").alias("who2"), F.col("w").alias("w2"), F.sum(F.col("new").cast("long")).over(order).alias("spell"))
    timed = rows.where("w is not null").join(spells, F.col("who").eqNullSafe(F.col("who2")) & (F.col("w") == F.col("w2")))
    timed = timed.withColumn("k", F.row_number().over(Window.partitionBy("who", "spell").orderBy("t", "row"))).select("k", "t", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[float] = []
        for batch in batches:
            t, first = batch.column(1).to_numpy(), np.flatnonzero(batch.column(0).to_numpy() == 1)
            ok = np.zeros(len(t), bool)
            for a, z in zip(np.r_[0, first], np.r_[first, len(t)], strict=True):
                passed = [] if a < z and (a == first).any() else passed
                i = a
                while i < z:
                    if len(passed) >= most:
                        i = max(i, a + int(np.searchsorted(t[a:z], passed[-most] + window_s, "right")))
                        if i == z:
                            break
                    ok[i] = True
                    passed = [*passed[1 - most :], t[i]] if most > 1 else [t[i]]
                    i += 1
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(ok)], ["row", "accepted"])

    made = timed.mapInArrow(run, StructType([timed.schema["row"], StructField("accepted", BooleanType())]))
    return made.union(rows.where("w is null").select("row", F.lit(None).cast("boolean"))).select(*(F.col("row")[c].alias(c) for c in names), "accepted")


def field_figures(field: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, median_ms, p90_ms, p99_ms, max_ms, masked_pct) of the speeds of a field (keys, u, v); null or NaN is masked."""
    speed = F.nanvl(F.hypot("u", "v"), F.lit(None).cast("double"))
    q = F.percentile(speed, F.array(*(F.lit(x) for x in (0.5, 0.9, 0.99))))
    each = field.groupBy(*keys).agg(q.alias("q"), F.max(speed).alias("max_ms"), (100.0 * (1 - F.count(speed) / F.count("*"))).alias("masked_pct"))
    return each.select(*keys, *(F.col("q")[i].alias(c) for i, c in enumerate(("median_ms", "p90_ms", "p99_ms"))), "max_ms", "masked_pct")


def hold_last(field: DataFrame, keys: list[str], t: str = "t_epoch") -> DataFrame:
    """A field whose last time is repeated one step of its own cadence later; a field of one time stays as it is."""
    times = field.select(*keys, t).distinct().withColumn("_gap", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t)))
    last = times.groupBy(*keys).agg(F.max_by("_gap", t).alias("_gap"), F.max(t).alias("_last")).where("_gap is not null")
    more = field.join(last, keys).where(F.col(t) == F.col("_last")).withColumn(t, F.col(t) + F.col("_gap"))
    return field.unionByName(more.select(*field.columns))


def _flat_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    return F.hypot((lon_a - lon_b) * KM_PER_DEG * F.cos(F.radians((lat_a + lat_b) / 2)), (lat_a - lat_b) * KM_PER_DEG)


def seed_provenance(first_frame: DataFrame, seeds: DataFrame, match_km: float = MATCH_KM) -> DataFrame:
    """(case_id, chosen_km, other_km, vouched): whether particles (case_id, lon, lat) began at the seed.

    seeds: (case_id, lon, lat, other_lon, other_lat), the other being the seed not chosen, or null.
    The mean of the first frame must lie within match_km of the seed, and nearer to it than to the other.
    """
    mean = first_frame.groupBy("case_id").agg(F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    both = seeds.join(mean, "case_id", "left")
    km = lambda lon, lat: _flat_km(F.col("x"), F.col("y"), F.col(lon), F.col(lat))
    both = both.withColumns({"chosen_km": km("lon", "lat"), "other_km": km("other_lon", "other_lat")})
    near = (F.col("chosen_km") <= match_km) & F.coalesce(F.col("chosen_km") < F.col("other_km"), F.lit(True))
    return both.select("case_id", "chosen_km", "other_km", F.coalesce(near, F.lit(False)).alias("vouched"))


def forward_document(particles: DataFrame, t0: DataFrame, minutes: float) -> DataFrame:
    """(case_id, n_steps, n_particles, body): the forward run of a case (case_id, step, pid, lon, lat) as one JSON document.

    t0: (case_id, t0) with the time as text. A case keeps a few hundred particles by design.
    """
    spot = F.array_sort(F.collect_list(F.struct("pid", "lon", "lat")))
    steps = particles.groupBy("case_id", "step").agg(F.transform(spot, lambda p: F.array(p["lon"], p["lat"])).alias("ps"))
    whole = steps.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "ps"))), lambda s: s["ps"]).alias("positions")).join(t0, "case_id")
    n, m = F.size("positions"), F.size(F.col("positions")[0])
    body = F.to_json(F.struct("t0", F.lit("forward").alias("direction"), F.lit(minutes).alias("timestep_minutes"), n.alias("n_steps"), m.alias("n_particles"), "positions"))
    return whole.select("case_id", n.alias("n_steps"), m.alias("n_particles"), body.alias("body"))


def close_mask(mask: DataFrame, scenes: DataFrame, size: int = 7) -> DataFrame:
    """Morphological closing with an ellipse: mask (scene_id, r, c) of set pixels, scenes (scene_id, rows, cols).

    Set pixels reach their neighbours, and a pixel stays if all its neighbours inside the scene were
    reached; a task holds one tile and what the ellipse reaches beside it. Pixels outside their scene are left out.
    """
    own = mask.select("scene_id", "r", "c").hint("merge").join(scenes.groupBy("scene_id").agg(F.max("rows").alias("_rows"), F.max("cols").alias("_cols")), "scene_id")
    own = own.where((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("_rows")) & (F.col("c") < F.col("_cols"))).select("scene_id", "r", "c", F.lit(1.0).alias("v"))
    shut = over_tiles(own, scenes, 2 * (size // 2), lambda a: closed(a > 0, size))
    return shut.select("scene_id", *(F.col(x).cast(mask.schema[x].dataType).alias(x) for x in ("r", "c")))


def regions_of_scores(scores: DataFrame, scenes: DataFrame, threshold: float, pixel_km2: float, size: int = 7, least_km2: float = 0.02, most_km2: float = 500.0, least_extent: int = 60) -> DataFrame:
    """(scene_id, region_id, n_px, area_km2, r0, r1, c0, c1) from scores (scene_id, r, c, p, valid).

    Pixels at the threshold or above, closed, fall into 8-connected regions that are large or long
    enough, and not too large; ids follow the first pixel. Regions are labelled over tiles, so a task
    holds no more than one.
    """
    shut = close_mask(scores.where((F.col("p") >= threshold) & F.col("valid")).select("scene_id", "r", "c"), scenes, size)
    each = region_figures(labelled(shut)).withColumn("area_km2", F.col("n_px") * pixel_km2)
    long = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1 >= least_extent
    each = each.where((F.col("area_km2") <= most_km2) & ((F.col("area_km2") >= least_km2) | long))
    order = F.row_number().over(Window.partitionBy("scene_id").orderBy("label"))
    return each.select("scene_id", order.alias("region_id"), "n_px", "area_km2", "r0", "r1", "c0", "c1")


def shrunk(pixels: DataFrame, factor: int, value: str = "db") -> DataFrame:
    """(scene_id, r, c, value): means over squares of factor x factor pixels; nulls are left out of a mean."""
    return pixels.groupBy("scene_id", F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(value).alias(value))


def comparison(measured: DataFrame, baselines: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """(method, metric, value, definition): measured and published figures in one long table.

    Both have a method and a column for each metric; a metric that one lacks is null there.
    """
    wide = measured.unionByName(baselines, allowMissingColumns=True)
    long = wide.unpivot(["method"], list(definitions), "metric", "value")
    says = F.create_map(*(F.lit(x) for kv in definitions.items() for x in kv))
    return long.withColumn("definition", says[F.col("metric")])
