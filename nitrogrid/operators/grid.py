"""Grid blocks: variables by alias, validation, structure, tiles, and flattening to rows."""

from pyspark.sql import functions as F

from nitrogrid import constants as K
from nitrogrid.functions.geo import axis_values
from nitrogrid.operators.partitioning import spread
from nitrogrid.schemas import GRID_BLOCK

VARIABLES = ["no2", "latitude", "longitude", "time"]
MODES = ("strict", "lenient")


def find_variables(columns, aliases=None):
    """Canonical name -> all accepted names that exist, in order."""
    aliases = K.VARIABLE_ALIASES if aliases is None else aliases
    return {
        name: list(dict.fromkeys(a for a in [*accepted, name] if a in columns))
        for name, accepted in aliases.items()
    }


def extract_variables(df, aliases=None):
    """Rename variables to canonical names; a variable that is not there is null.

    Each row takes the first accepted name that it has a value for, so blocks of files with
    different names can stand in one frame.
    """
    found = find_variables(df.columns, aliases)
    types = {f.name: f.dataType for f in GRID_BLOCK}
    used = {a for names in found.values() for a in names}
    extra = [f"`{c}`" for c in df.columns if c not in used]
    return df.select(*extra, *[
        F.coalesce(*[F.col(f"`{a}`").cast(types[name]) for a in names], F.lit(None).cast(types[name])).alias(name)
        for name, names in found.items()
    ])


def _check_mode(mode):
    if mode not in MODES:
        raise ValueError("mode must be 'strict' or 'lenient'")


def _sizes():
    nt, nlat, nlon = (F.size(c).cast("long") for c in ("time", "latitude", "longitude"))
    return nt, nlat, nlon, F.size("no2").cast("long")


def validate_blocks(blocks, mode="strict"):
    """Add ``error``, null for a usable block.

    Strict: all four variables are required. Lenient: what exists must agree in size. A block
    without any variable is rejected in either mode, with the decoder's error if there is one.
    """
    _check_mode(mode)
    nt, nlat, nlon, n = _sizes()
    missing = F.lit(None).cast("string")
    if mode == "strict":
        for name in reversed(VARIABLES):
            missing = F.when(F.col(name).isNull(), F.lit(f"missing variable: {name}")).otherwise(missing)
    has_no2, has_time = F.col("no2").isNotNull(), F.col("time").isNotNull()
    has_grid = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    points = nlat * nlon
    expected = F.when(has_grid, F.when(has_time, nt * points).otherwise(points)).when(has_time, nt)
    mismatch = F.when(has_no2 & (n != expected), F.lit("sizes of variables differ"))
    nothing = F.when(~F.greatest(*[F.col(v).isNotNull() for v in VARIABLES]), F.lit("no variables"))
    decoder = F.col("decode_error") if "decode_error" in blocks.columns else F.lit(None).cast("string")
    return blocks.withColumn("error", F.coalesce(decoder, missing, nothing, mismatch))


def valid_blocks(checked):
    return checked.filter(F.col("error").isNull()).drop("error", "decode_error")


def rejected_blocks(checked):
    return checked.filter(F.col("error").isNotNull()).select("source_file", "error")


def flatten_grid(blocks, mode="strict", bbox=None, keep=("source_file",), drop=True):
    """One row per grid value: ``keep..., no2, latitude, longitude, time``.

    Strict mode drops rows with any missing value. Lenient mode looks only at the variables
    that the block has. ``bbox = (lat_lo, lat_hi, lon_lo, lon_hi)`` selects array positions
    before rows are made; a block without coordinates has no point in any box. Nothing is shuffled.
    """
    good = valid_blocks(validate_blocks(blocks, mode))
    rows = _flatten_box(good, mode, bbox, keep) if bbox else _flatten_all(good, mode, keep)
    if not drop:
        return rows.drop("_grid", "_no2", "_time")
    if mode == "strict":
        return rows.na.drop("any", subset=VARIABLES)
    ok_no2 = ~F.col("_no2") | (F.col("no2").isNotNull() & ~F.isnan("no2"))
    ok_time = ~F.col("_time") | F.col("time").isNotNull()
    ok_grid = ~F.col("_grid") | (
        F.col("latitude").isNotNull() & ~F.isnan("latitude")
        & F.col("longitude").isNotNull() & ~F.isnan("longitude")
    )
    return rows.filter(ok_no2 & ok_time & ok_grid).drop("_grid", "_no2", "_time")


def _flatten_all(blocks, mode, keep):
    nt, nlat, nlon, _ = _sizes()
    flags = {}
    if mode == "lenient":
        has_grid = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        flags = {
            "_grid": has_grid, "_no2": F.col("no2").isNotNull(), "_time": F.col("time").isNotNull(),
        }
        # without values the block still has one row per grid point and time
        steps = F.when(F.col("time").isNull(), F.lit(1)).otherwise(nt)
        points = F.when(has_grid, nlat * nlon).otherwise(F.lit(1))
        blank = F.array_repeat(F.lit(None).cast("float"), (steps * points).cast("int"))
        no_variable = ~has_grid & F.col("time").isNull()
        blocks = blocks.withColumns({
            **flags,
            "no2": F.coalesce("no2", F.when(~no_variable, blank)),
            "latitude": F.when(has_grid, F.col("latitude")),
            "longitude": F.when(has_grid, F.col("longitude")),
        })
    rows = blocks.select(
        *keep, *flags, "latitude", "longitude", "time", F.posexplode("no2").alias("_p", "_v")
    )
    # points per time step; without a grid every value is its own time step
    position, width = F.col("_p").cast("long"), nlon
    points = F.coalesce(nlat * nlon, F.lit(1)) if mode == "lenient" else nlat * nlon
    step = _div(position, points)
    return rows.select(
        *keep,
        *flags,
        F.col("_v").cast("double").alias("no2"),
        F.get("latitude", (_div(position, width) % nlat).cast("int")).alias("latitude"),
        F.get("longitude", (position % width).cast("int")).alias("longitude"),
        F.get("time", step.cast("int")).alias("time"),
    )


def _div(a, b):
    return F.call_function("div", a, b)


def _flatten_box(blocks, mode, bbox, keep):
    lat_lo, lat_hi, lon_lo, lon_hi = bbox

    def positions(axis, lo, hi):
        index = F.sequence(F.lit(0), F.size(axis) - 1)
        return F.filter(index, lambda i: F.get(axis, i).between(lo, hi))

    nlat, nlon = F.size("latitude"), F.size("longitude")
    flags = {}
    if mode == "lenient":
        flags = {"_grid": F.lit(True), "_no2": F.col("no2").isNotNull(), "_time": F.col("time").isNotNull()}
        # a block without time has one step, whose time is null
        blocks = blocks.withColumns({
            **flags, "time": F.coalesce("time", F.array(F.lit(None).cast("timestamp_ntz"))),
        })
    boxed = blocks.filter(
        (F.size("time") > 0) & (nlat > 0) & (nlon > 0)
    ).withColumns({
        "_la": positions("latitude", lat_lo, lat_hi), "_lo": positions("longitude", lon_lo, lon_hi),
    }).filter((F.size("_la") > 0) & (F.size("_lo") > 0))
    # first one row per time and latitude, with that latitude's slice of the values, then the
    # longitudes: no row holds more values than the block did
    lines = F.flatten(F.transform(
        F.sequence(F.lit(0), F.size("time") - 1),
        lambda t: F.transform("_la", lambda la: F.struct(
            F.get("time", t).alias("time"),
            F.get("latitude", la).alias("latitude"),
            F.slice("no2", (t * nlat + la) * nlon + 1, nlon).alias("_line"),
        )),
    ))
    line = boxed.select(*keep, *flags, "longitude", "_lo", F.inline(lines))
    return line.select(*keep, *flags, "longitude", "time", "latitude", "_line", F.explode("_lo").alias("_i")).select(
        *keep, *flags,
        F.get("_line", F.col("_i")).cast("double").alias("no2"),
        "latitude",
        F.get("longitude", F.col("_i")).alias("longitude"),
        "time",
    )


def tile_blocks(blocks, rows_per_tile=64, keep=("source_file",)):
    """Cut each block into one tile per time step and band of latitude rows.

    A full-resolution granule is one very large row; tiles make the table scan, filter and
    flatten in parallel. The extent columns let a box filter skip tiles at the scan.
    """
    nlat, nlon = F.size("latitude"), F.size("longitude")
    checked = valid_blocks(validate_blocks(blocks)).filter(
        (F.size("time") > 0) & (nlat > 0) & (nlon > 0)
    )
    attrs = [c for c in ("var_attrs", "ds_attrs") if c in blocks.columns]

    def tile(step, offset):
        band = F.slice("latitude", offset + 1, F.lit(rows_per_tile))
        first = (step * nlat + offset) * nlon + 1
        return F.struct(
            step.alias("time_index"),
            offset.alias("lat_offset"),
            F.array(F.get("time", step)).alias("time"),
            band.alias("latitude"),
            F.slice("no2", first, F.size(band) * nlon).alias("no2"),
            F.array_min(band).alias("lat_min"),
            F.array_max(band).alias("lat_max"),
        )

    # the slices are cut inside the row: exploding rows that carry the whole value array
    # would copy it once per tile
    steps = F.sequence(F.lit(0), F.size("time") - 1)
    offsets = F.sequence(F.lit(0), nlat - 1, F.lit(rows_per_tile))
    tiles = F.flatten(F.transform(steps, lambda t: F.transform(offsets, lambda o: tile(t, o))))
    return checked.select(
        *keep, "longitude",
        F.array_min("longitude").alias("lon_min"), F.array_max("longitude").alias("lon_max"),
        *attrs, F.inline(tiles),
    )


def tiles_in_box(tiles, bbox):
    """Tiles that can hold a point of the box; plain column tests, so they reach the scan."""
    lat_lo, lat_hi, lon_lo, lon_hi = bbox
    return tiles.filter(
        (F.col("lat_max") >= lat_lo) & (F.col("lat_min") <= lat_hi)
        & (F.col("lon_max") >= lon_lo) & (F.col("lon_min") <= lon_hi)
    )


def dataset_structure(blocks):
    """Rows ``source_file, kind, name, shape, dtype, attrs`` for each block."""
    types = {f.name: f.dataType for f in blocks.schema}

    def dtype(name):
        return F.lit(types[name].elementType.simpleString())

    def size(name):
        return F.size(name).cast("string")

    empty = F.create_map().cast("map<string,string>")
    var_attrs = F.coalesce("var_attrs", empty) if "var_attrs" in types else empty
    ds_attrs = F.coalesce("ds_attrs", empty) if "ds_attrs" in types else empty

    def row(kind, name, shape, kind_of_value, attrs=empty):
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), shape.alias("shape"),
            kind_of_value.alias("dtype"), attrs.alias("attrs"),
        )

    none = F.lit(None).cast("string")
    axes = ("time", "latitude", "longitude")
    shape = F.concat_ws(",", *[size(c) for c in axes])
    rows = [
        F.when(F.col(c).isNotNull(), row(kind, c, size(c), dtype(c) if kind == "coordinate" else none))
        for kind in ("dimension", "coordinate") for c in axes
    ]
    rows.append(F.when(F.col("no2").isNotNull(), row("variable", "no2", shape, dtype("no2"), var_attrs)))
    extra = F.transform(
        F.map_entries(ds_attrs),
        lambda e: row("attribute", e["key"], none, none, F.create_map(F.lit("value"), e["value"])),
    )
    listing = F.concat(F.array_compact(F.array(*rows)), extra)
    return blocks.select("source_file", F.explode(listing).alias("r")).select("source_file", "r.*")


def regular_grid(days, resolution=0.2, box=None):
    """Every row of ``days`` at every point of a regular grid over a box, latitude first.

    Rows are spread over tasks while there is one per day and latitude, before the longitudes
    multiply them.
    """
    lat_lo, lat_hi, lon_lo, lon_hi = box or (K.LAT_MIN, K.LAT_MAX, K.LON_MIN, K.LON_MAX)
    rows = days.select("*", F.explode(axis_values(lat_lo, lat_hi, resolution)).alias("latitude"))
    rows = spread(rows, *days.columns, "latitude")
    return rows.select("*", F.explode(axis_values(lon_lo, lon_hi, resolution)).alias("longitude"))
