"""Vessels against a few cases: positions are shuffled once by vessel, and many whole vessels are held against all cases in one call.

A case's extract is never written: with cases that overlap it would be many times the positions.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM
from ..functions.scalars import identity_problem
from ..operators import ingest, score, tracks
from ..operators.regions import whole_groups

#: Cases and places of their grids that are sent to the executors; more meet positions by cells (cases.extracts).
MOST_CASES, MOST_PLACES = 1000, 500_000
#: Positions and walked instants held in one call, but for a vessel of more.
BATCH, INSTANTS = 100_000, 1_000_000
_BOX = ("west", "south", "east", "north", "start", "stop")
_DOUBLES = ("value", "lon", "lat", "underway_median", "gap_min", "g_sog", "g_next_sog", "g_lon", "g_lat", "o_lon", "o_lat", "o_cog", "near_sog", "w", "e", "s", "n_")
_LONGS = ("at_us", "n_noaa", "n_gfw", "g_source", "g_next_source", "o_source", "heard")


def few(cases: DataFrame, cells: DataFrame, pad_hours: float, least_km: float) -> tuple[pa.Array, list[dict]] | None:
    """Ids of the cases and what a pass needs of each, its grid as an array; None where they are too many to be sent."""
    place = F.col("rows").cast("long") * F.col("cols")
    n, places = cases.agg(F.count("*"), F.coalesce(F.sum(F.when(place > 0, place)), F.lit(0))).first()
    if n > MOST_CASES or places > MOST_PLACES:
        return None
    us = lambda c: F.unix_micros(c).alias(c)
    box = ingest.search_box(cases, pad_hours, least_km).select("case_id", *(us(c) if c.startswith("st") else c for c in _BOX)).select("case_id", F.struct(*_BOX).alias("box"))
    heads = cases.select("case_id", *(F.col(c).cast("double").alias(c) for c in ("west", "south", "east", "north", "clon", "clat", "radius_90_km")), "rows", "cols", us("window_start"), us("window_end"))
    heads = heads.join(box, "case_id").where("window_start is not null and window_end is not null and rows > 0 and cols > 0").toArrow()
    inside = cells.where("p > 0 and r >= 0 and c >= 0").join(cases.select("case_id", "rows", "cols"), "case_id").where("r < rows and c < cols")
    grid = inside.groupBy("case_id", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).agg(F.max("p").alias("p")).toArrow()
    ids, made = heads["case_id"].combine_chunks(), heads.drop_columns(["case_id"]).to_pylist()
    made = [{x: np.nan if y is None else y for x, y in m.items() if x != "box"} | {f"b_{x}": np.nan if y is None else y for x, y in m["box"].items()} for m in made]
    for m in made:
        m["grid"] = np.zeros((int(m["rows"]), int(m["cols"])))
    known = {x: k for k, x in enumerate(ids.to_pylist())}
    k = np.array([known.get(x, -1) for x in grid["case_id"].to_pylist()], np.int64)
    r, c, p = (grid[x].to_numpy() for x in ("r", "c", "p"))
    for of in np.unique(k[k >= 0]):
        own = k == of
        made[of]["grid"][r[own], c[own]] = p[own]
    return ids, made


def _node(case: dict, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """The grid's value at the nearest node; zero outside."""
    p = np.zeros(len(lon))
    at = np.flatnonzero((lon >= case["west"]) & (lon <= case["east"]) & (lat >= case["south"]) & (lat <= case["north"]))
    if len(at):
        rows, cols = case["grid"].shape
        r = np.rint((case["north"] - lat[at]) / (case["north"] - case["south"]) * (rows - 1)).astype(np.int64)
        c = np.rint((lon[at] - case["west"]) / (case["east"] - case["west"]) * (cols - 1)).astype(np.int64)
        p[at] = case["grid"][r, c]
    return p


def _km(lon: np.ndarray, lat: np.ndarray, lon2: float, lat2: float) -> np.ndarray:
    up, side = np.sin(np.radians(lat2 - lat) / 2), np.sin(np.radians(lon2 - lon) / 2)
    return 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(up * up + np.cos(np.radians(lat)) * np.cos(np.radians(lat2)) * side * side)))


def _points(case: dict, who: np.ndarray, t: dict[str, np.ndarray], last: np.ndarray, gap: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int | None, dense_min: float, hourly_min: float) -> tuple[np.ndarray, ...]:  # noqa: PLR0913
    """(vessel, p, walked, at, lon, lat) of reports in the window and walked instants on plausible places."""
    u, x, y, s = t["us"], t["lon"], t["lat"], t["source"]
    made = []

    def put(vessel: np.ndarray, walked: bool, at: np.ndarray, lon: np.ndarray, lat: np.ndarray) -> None:
        p = _node(case, lon, lat)
        hit = p > score.PLAUSIBLE_MIN
        made.append((vessel[hit], p[hit], np.full(int(hit.sum()), walked), at[hit], lon[hit], lat[hit]))

    own = np.flatnonzero((u >= case["window_start"]) & (u <= case["window_end"]))
    put(who[own], False, u[own], x[own], y[own])
    if step:
        after = np.minimum(np.arange(len(u)) + 1, len(u) - 1)
        both, labelled = (s == 1) & (s[after] == 1), (s >= 0) & (s[after] >= 0)
        a = np.flatnonzero(~last & (gap <= np.where(labelled & ~both, min(dense_min, hourly_min), dense_min)))
        first = begin[who[a]]
        most = np.floor((end[who[a]] - first) / step)
        low = np.maximum(np.floor((u[a] - first) / step) + 1, 1).astype(np.int64)
        high = np.minimum(np.ceil((u[a + 1] - first) / step) - 1, most).astype(np.int64)
        some = low <= high
        a, first, low, n = a[some], first[some], low[some], (high - low + 1)[some]
        part = (np.cumsum(n) - n) // INSTANTS
        cut = [0, *(np.flatnonzero(np.diff(part)) + 1), len(a)] if len(a) else []
        for lo, hi in pairwise(cut):
            of = slice(lo, hi)
            m = n[of]
            j = np.repeat(a[of], m)
            k = np.repeat(low[of], m) + np.arange(len(j)) - np.repeat(np.cumsum(m) - m, m)
            at = np.repeat(first[of], m) + k * step
            share = (at - u[j]) / (u[j + 1] - u[j])
            put(who[j], True, at, x[j] + share * (x[j + 1] - x[j]), y[j] + share * (y[j + 1] - y[j]))
    return tuple(np.concatenate(z) for z in zip(*made, strict=True))


def _pass(case: dict, v: np.ndarray, t: dict[str, np.ndarray], typed: np.ndarray, min_points: int, dense_min: float, hourly_min: float, walk_seconds: int | None) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:  # noqa: PLR0913
    """What plausible vessels show of one case, as columns; a row of each for its name, and for its type or -1. The last row, of no vessel, has the extent of all usable tracks."""
    lon, lat, us = t["lon"], t["lat"], t["us"]
    i = np.flatnonzero((us >= case["b_start"]) & (us < case["b_stop"]) & (lon >= case["b_west"]) & (lon <= case["b_east"]) & (lat >= case["b_south"]) & (lat <= case["b_north"]))
    if not len(i):
        return None
    g = np.flatnonzero(np.append(True, v[i[1:]] != v[i[:-1]]))
    n = np.diff(np.append(g, len(i)))
    count = lambda flag, begins: np.add.reduceat(flag.astype(np.int64), begins)
    dense, hourly = count(t["source"][i] == 1, g), count(t["source"][i] == 2, g)
    a, b = us[i[g]], us[i[g + n - 1]]
    ok = (n >= min_points) & ((dense >= min_points) | ((hourly > 0) & (n >= 2))) & ~((b < case["window_start"]) | (a > case["window_end"]))
    if not ok.any():
        return None
    i, n, dense, hourly, a, b = i[np.repeat(ok, n)], n[ok], dense[ok], hourly[ok], a[ok], b[ok]
    who, own = np.repeat(np.arange(len(n)), n), {c: x[i] for c, x in t.items()}
    u, x, y, sog = own["us"], own["lon"], own["lat"], own["sog"]
    last = np.append(who[1:] != who[:-1], True)
    after = np.minimum(np.arange(len(i)) + 1, len(i) - 1)
    gap = (u[after] - u) / 60e6
    out = {c: np.full(1, np.nan) for c in _DOUBLES} | {c: np.zeros(1, np.int64) for c in _LONGS}
    out |= {"w": np.array([x.min()]), "e": np.array([x.max()]), "s": np.array([y.min()]), "n_": np.array([y.max()])}
    begin, end = np.maximum(a, case["window_start"]), np.minimum(b, case["window_end"])
    vessel, p, walked, at, px, py = _points(case, who, own, last, gap, begin, end, walk_seconds and walk_seconds * 1_000_000, dense_min, hourly_min)
    none = np.full(1, -1)
    if not len(vessel):
        return out, none, none
    order = np.lexsort((at, walked, -p, vessel))
    order = order[np.append(True, np.diff(vessel[order]) != 0)]
    found, p, at, px, py = (z[order] for z in (vessel, p, at, px, py))
    place = np.full(len(n), -1)
    place[found] = np.arange(len(found))
    f = np.flatnonzero(place[who] >= 0)  # fixes of the plausible vessels
    fw = place[who[f]]
    g = np.flatnonzero(np.append(True, fw[1:] != fw[:-1]))
    first = lambda flag: np.minimum.reduceat(np.where(flag, f, len(i)), g)
    final = lambda flag: np.maximum.reduceat(np.where(flag, f, -1), g)
    value = lambda z, k, some: np.where(some, z[np.where(some, k, 0)], np.nan)
    code = lambda k, some: np.where(some, own["source"][np.where(some, k, 0)], -1).astype(np.int64)
    outside = final((_km(x[f], y[f], case["clon"], case["clat"]) >= case["radius_90_km"]) & (u[f] <= at[fw]))
    apart = np.abs(u[f] - at[fw])
    near = first(apart == np.minimum.reduceat(apart, g)[fw])
    over = ~last[f] & (u[f] < case["window_end"]) & (u[after[f]] > case["window_start"])
    longest = np.maximum.reduceat(np.where(over, gap[f], -1.0), g)
    silent = longest >= 0
    k = first(over & (gap[f] == longest[fw]))
    since, until = (np.where(silent, z[np.where(silent, k, 0)], 0) for z in (u, u[after]))
    heard = count((own["source"][f] == 2) & (u[f] > since[fw]) & (u[f] < until[fw]), g)
    moving = np.flatnonzero(sog[f] >= tracks.UNDERWAY_KNOTS)
    m = np.bincount(fw[moving], minlength=len(found))
    speeds = sog[f][moving][np.lexsort((sog[f][moving], fw[moving]))]
    start, often = np.cumsum(m) - m, m >= 3
    middle = 0.5 * value(speeds, start + (m - 1) // 2, often) + 0.5 * value(speeds, start + m // 2, often) if len(speeds) else np.full(len(found), np.nan)
    had = outside >= 0
    rows = {
        "value": p, "at_us": at, "lon": px, "lat": py, "n_noaa": dense[found], "n_gfw": hourly[found], "underway_median": middle,
        "gap_min": np.where(silent, longest, np.nan), "g_sog": value(sog, k, silent), "g_next_sog": value(sog[after], k, silent), "g_lon": value(x, k, silent), "g_lat": value(y, k, silent), "g_source": code(k, silent),
        "g_next_source": np.where(silent, own["source"][after[np.where(silent, k, 0)]], -1), "heard": heard, "near_sog": sog[near],
        "o_lon": value(x, outside, had), "o_lat": value(y, outside, had), "o_cog": value(own["cog"], outside, had), "o_source": np.where(had, code(outside, had), -2),
    }
    rows |= {c: np.full(len(found), np.nan) for c in ("w", "e", "s", "n_")}
    kind = final(typed[i[f]])
    return {c: np.concatenate([rows[c], out[c]]) for c in out}, np.append(i[f[g]], -1), np.append(np.where(kind >= 0, i[kind], -1), -1)


def passes(positions: DataFrame, kind: str, ids: pa.Array, cases: list[dict], min_points: int, dense_min: float, hourly_min: float, walk_seconds: int | None) -> DataFrame:
    """(case_id, mmsi, value, at, lon, lat, n_noaa, n_gfw, vessel_type, underway_median, g, o, near, heard) of plausible vessels; rows without mmsi have w, e, s, n_, the extent of usable tracks.

    kind: the SQL type of ids; ids, cases: of ``few``. Of a silence or an origin only the fields that the scores read are kept. What is not a number counts as null.
    """
    spark = positions.sparkSession
    named = F.coalesce(identity_problem(F.col("mmsi")) == "no country code", F.lit(True))
    code = F.when(F.col("source").isNull(), -1).when(F.col("source") == "noaa", 1).when(F.col("source") == "gfw", 2).otherwise(0).cast("byte")
    near = F.lit(False)
    if cases:
        low, high = {c: min(k[f"b_{c}"] for k in cases) for c in ("west", "south", "start")}, {c: max(k[f"b_{c}"] for k in cases) for c in ("east", "north", "stop")}
        near = F.col("lon").between(low["west"], high["east"]) & F.col("lat").between(low["south"], high["north"]) & (F.unix_micros("ts") >= low["start"]) & (F.unix_micros("ts") < high["stop"])
    own = positions.where(named & near).select("mmsi", F.unix_micros("ts").alias("us"), *(F.col(c).cast("double").alias(c) for c in ("lon", "lat", "sog", "cog")), code.alias("source"), "vessel_type")

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= BATCH:
                yield pa.concat_batches(held)
                held, n = [], 0
        if held:
            yield pa.concat_batches(held)

    def many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(gathered(batches), ["mmsi"]):
            v = np.repeat(np.arange(len(at)), np.diff(np.append(at, t.num_rows)))
            columns = {c: t[c].to_numpy() for c in ("us", "lon", "lat", "sog", "cog", "source")}
            typed = t["vessel_type"].is_valid().to_numpy()
            made = [(k, *m) for k, case in enumerate(cases) if (m := _pass(case, v, columns, typed, min_points, dense_min, hourly_min, walk_seconds)) is not None]
            if made:
                pick = lambda column, rows: column.combine_chunks().take(pa.array(rows, mask=rows < 0))
                of = np.concatenate([np.full(len(rows), k) for k, _, rows, _ in made])
                named, typical = (np.concatenate([m[j] for m in made]) for j in (2, 3))
                numbers = [pa.array(np.concatenate([m[c] for _, m, _, _ in made]), from_pandas=True) for c in (*_DOUBLES, *_LONGS)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)), pick(t["mmsi"], named), pick(t["vessel_type"], typical), *numbers], ["case_id", "mmsi", "vessel_type", *_DOUBLES, *_LONGS])

    sent = own.repartition(4 * spark.sparkContext.defaultParallelism, "mmsi").sortWithinPartitions("mmsi", "us")
    return sent.mapInArrow(many, f"case_id {kind}, mmsi string, vessel_type string, {', '.join(f'{c} double' for c in _DOUBLES)}, {', '.join(f'{c} long' for c in _LONGS)}")


def shown(found: DataFrame) -> DataFrame:
    """Rows of ``passes`` with a vessel, as cases.suspects reads them."""
    of = lambda c: F.when(F.col(c) == 2, "gfw").when(F.col(c) == 1, "noaa").alias(c.removeprefix("g_").removeprefix("o_"))
    silence = F.struct("gap_min", F.col("g_sog").alias("sog"), F.col("g_next_sog").alias("next_sog"), F.col("g_lon").alias("lon"), F.col("g_lat").alias("lat"), of("g_source"), of("g_next_source"))
    origin = F.when(F.col("o_source") > -2, F.struct(F.col("o_lon").alias("lon"), F.col("o_lat").alias("lat"), F.col("o_cog").alias("cog"), of("o_source")))
    return found.where("mmsi is not null").select("case_id", "mmsi", "value", F.timestamp_micros("at_us").alias("at"), "lon", "lat", "n_noaa", "n_gfw", "vessel_type", "underway_median", silence.alias("g"), origin.alias("o"), F.struct(F.col("near_sog").alias("sog")).alias("near"), "heard")
