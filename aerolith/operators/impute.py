"""Gap repair: bounded forward fill, linear interpolation, rolling median."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from aerolith.operators import series as S
from aerolith.schema import (
    AIR_FILL_LIMIT,
    INTERPOLATED,
    MEDIAN_FILLED,
    MEDIAN_ROWS,
    RAW,
    WEATHER_FILL_LIMIT,
)


def _present(df, cols):
    return [c for c in cols if c in df.columns]


def forward_fill(name: str, limit: int, window) -> Column:
    """The last value of the current and the ``limit`` rows before it."""
    return F.last(name, ignorenulls=True).over(window.rowsBetween(-limit, 0))


def _fill_columns(df, window):
    out = {c: forward_fill(c, WEATHER_FILL_LIMIT, window) for c in _present(df, INTERPOLATED)}
    out |= {c: forward_fill(c, AIR_FILL_LIMIT, window) for c in _present(df, MEDIAN_FILLED)}
    return out


def fill_gaps(df: DataFrame, layout: S.Layout | None = None) -> DataFrame:
    """Bounded forward fill of weather (3 rows) and pollutants (2 rows)."""
    layout = layout or S.choose_layout(df)
    ready = S.prepare(df, layout, WEATHER_FILL_LIMIT)
    return S.finish(ready.withColumns(_fill_columns(ready, layout.window())), layout)


def _middle(values: Column) -> Column:
    """Median of an array without NULLs; NULL when empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _median_filled(df, cols, window, preceding, following):
    """Fill what is still NULL with the median of the rows around it.

    Neighbours are fetched once per row as one struct; the median itself is
    computed only where the value is missing.
    """
    packed = "_packed"
    offsets = [o for o in range(-preceding, following + 1) if o != 0]
    around = [
        (F.lag(packed, -o) if o < 0 else F.lead(packed, o)).over(window).alias(f"_n{i}")
        for i, o in enumerate(offsets)
    ]
    near = (
        df.withColumn(packed, F.struct(*cols))
        .select("*", *around)
    )

    def filled(c):
        values = F.array_compact(F.array(*[F.col(f"_n{i}.{c}") for i in range(len(offsets))]))
        return F.when(F.col(c).isNotNull(), F.col(c)).otherwise(_middle(values))

    return near.withColumns({c: filled(c) for c in cols}).drop(
        packed, *[f"_n{i}" for i in range(len(offsets))]
    )


def median_impute(
    df: DataFrame, cols=MEDIAN_FILLED, rows: int = MEDIAN_ROWS, centered: bool = False,
    layout: S.Layout | None = None,
) -> DataFrame:
    """Fill NULLs with the median of a row frame of ``rows`` rows, NULLs skipped.

    Trailing frames end at the current row; centered frames reach half their
    rows back and the rest ahead.
    """
    layout = layout or S.choose_layout(df)
    cols = _present(df, cols)
    before = rows // 2 if centered else rows - 1
    after = rows - 1 - before
    ready = S.prepare(df, layout, before, after)
    return S.finish(_median_filled(ready, cols, layout.window(), before, after), layout)


def _interpolated(c: str, prev: Column, nxt: Column, pos: Column) -> Column:
    step = (nxt["v"] - prev["v"]) * (pos - prev["p"]) / (nxt["p"] - prev["p"])
    return (
        F.when(F.col(c).isNotNull(), F.col(c))
        .when(prev.isNull(), None)
        .when(nxt.isNull(), prev["v"])
        .otherwise(prev["v"] + step)
    )


def _interpolate(ready: DataFrame, cols, layout: S.Layout) -> DataFrame:
    """Linear interpolation by row position; trailing gaps repeat the last value."""
    w = layout.window()
    if not layout.chunked:
        ready = ready.withColumn(S.POS, F.row_number().over(w))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(S.POS).alias("p"), F.col(c).alias("v"))) for c in cols}
    near = ready.withColumns({f"_k_{c}": v for c, v in known.items()})
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = near.select(
        "*",
        *[F.last(f"_k_{c}", ignorenulls=True).over(up).alias(f"_prev_{c}") for c in cols],
        *[layout.next_known(f"_k_{c}").alias(f"_next_{c}") for c in cols],
    )
    prev = {c: F.col(f"_prev_{c}") for c in cols}
    nxt = {c: F.col(f"_next_{c}") for c in cols}
    if layout.chunked:
        edges = S.beyond_chunk(near, {c: F.col(f"_k_{c}") for c in cols}, layout)
        # A chunk that holds only looked-back copies has no summary of its own.
        out = out.join(edges, list(layout.by()), "left")
        prev = {c: F.coalesce(v, F.col(f"_before_{c}")) for c, v in prev.items()}
        nxt = {c: F.coalesce(v, F.col(f"_after_{c}")) for c, v in nxt.items()}
    filled = out.withColumns({c: _interpolated(c, prev[c], nxt[c], F.col(S.POS)) for c in cols})
    helpers = [f"{p}{c}" for c in cols for p in ("_k_", "_prev_", "_next_", "_before_", "_after_")]
    return filled.drop(*helpers) if layout.chunked else filled.drop(S.POS, *helpers)


def interpolate(df: DataFrame, cols=INTERPOLATED, layout: S.Layout | None = None) -> DataFrame:
    """Linear interpolation of the given columns within each series."""
    layout = layout or S.choose_layout(df)
    ready = S.prepare(df, layout, 0)
    return S.finish(_interpolate(ready, _present(df, cols), layout), layout)


def repair(df: DataFrame, layout: S.Layout, interpolated: bool = True) -> DataFrame:
    """Forward fill, then interpolate weather and median-fill pollutants.

    In chunks, the result keeps one looked-back row per chunk so that a step
    from the row before can be taken.  ``interpolated=False`` uses past values
    only.
    """
    look_back = max(WEATHER_FILL_LIMIT + 1, MEDIAN_ROWS - 1 + AIR_FILL_LIMIT + 1)
    w = layout.window()
    ready = S.prepare(df, layout, look_back)
    filled = ready.withColumns(_fill_columns(ready, w))
    filled = _median_filled(filled, _present(df, MEDIAN_FILLED), w, MEDIAN_ROWS - 1, 0)
    if layout.chunked:
        last_before = F.col(S.CHUNK) * layout.chunk_rows - 1
        filled = filled.filter(~F.col(S.HALO) | (F.col(S.POS) == last_before))
    weather = _present(df, INTERPOLATED)
    return _interpolate(filled, weather, layout) if interpolated and weather else filled


def handle_missing(df: DataFrame, layout: S.Layout | None = None, interpolated: bool = True) -> DataFrame:
    """All gap repair of the feature chain."""
    layout = layout or S.choose_layout(df)
    return S.finish(repair(df, layout, interpolated), layout)


def explore_clean(df: DataFrame, layout: S.Layout | None = None) -> DataFrame:
    """The exploration variant: all weather but rain interpolated, centered medians."""
    layout = layout or S.choose_layout(df)
    weather = [c for c in _present(df, RAW) if c not in (*MEDIAN_FILLED, "precipitation")]
    w = layout.window()
    ready = S.prepare(df, layout, WEATHER_FILL_LIMIT)
    out = ready.withColumns(
        {c: forward_fill(c, WEATHER_FILL_LIMIT, w) for c in weather}
        | {c: forward_fill(c, AIR_FILL_LIMIT, w) for c in _present(df, MEDIAN_FILLED)}
    )
    out = interpolate(S.finish(out, layout), weather, layout)
    if "precipitation" in df.columns:
        out = out.withColumn("precipitation", F.coalesce("precipitation", F.lit(0.0)))
    return median_impute(out, centered=True, layout=layout)
