"""Column functions of the event features (nulls stay null unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OUTBOUND = ["refund", "credit", "reversal"]


def log_amount(amount: Column) -> Column:
    return F.log1p(amount)


def round_score(amount: Column) -> Column:
    """0 to 3: one each for a whole unit, a whole hundred and a whole thousand."""
    cents = F.rint(amount * 100).cast("long")
    return sum(((cents % m == 0).cast("int") for m in (100, 10_000, 100_000)), F.lit(0))


def calendar(t_micros: Column) -> dict[str, Column]:
    """hour, dow (Monday 0), weekend and night (01 to 05) of wall-clock microseconds."""
    hour = F.floor(t_micros / 3_600_000_000) % 24
    dow = (F.floor(t_micros / 86_400_000_000) + 3) % 7  # 1970-01-01 was a Thursday
    return {"hour": hour.cast("int"), "dow": dow.cast("int"), "is_weekend": (dow >= 5).cast("int"), "is_night": hour.between(1, 5).cast("int")}


def direction(txn_type: Column, original: Column) -> dict[str, Column]:
    out = txn_type.isin(OUTBOUND)
    return {"is_outbound": out.cast("int"), "is_orphan_outbound": (out & original.isNull()).cast("int"), "is_refund": (txn_type == "refund").cast("int"), "is_credit": (txn_type == "credit").cast("int"), "is_preauth": (txn_type == "preauth").cast("int")}


def null_flags(*columns: str) -> dict[str, Column]:
    return {f"{c}_missing": F.col(c).isNull().cast("int") for c in columns}


def guarded(a: Column, b: Column) -> Column:
    """a / b where b is positive, else null."""
    return F.when(b > 0, a.cast("double") / b)


def in_scope(scope: Column, value: Column) -> Column:
    """Null without a list; 1 for an empty list; else whether the list has the value."""
    return F.when(scope.isNull(), F.lit(None)).when(F.size(scope) == 0, 1).otherwise(F.coalesce(F.array_contains(scope, value), F.lit(False)).cast("int")).cast("int")


def length(items: Column) -> Column:
    return F.when(items.isNotNull(), F.size(items))


def mandate_age(ts: Column, issued: Column, ttl: Column) -> dict[str, Column]:
    age = F.unix_timestamp(ts) - F.unix_timestamp(issued)
    return {"mandate_age": age, "mandate_age_share": guarded(age, ttl), "mandate_expired": ((ttl > 0) & (age > ttl)).cast("int"), "mandate_ttl": ttl}


def presence_mismatch(human_present: Column, cursor_entropy: Column) -> Column:
    """How little the cursor moved where a human was said to be present."""
    return F.when(human_present, F.greatest(F.lit(0.0), 1 - F.coalesce(cursor_entropy, F.lit(0.0))))


def z_score(x: Column, mean: float, std: float) -> Column:
    return (x - mean) / (std or 1.0)


def deliberation_residual(latency: Column, amount: Column, intercept: float, slope: float, sigma: float) -> Column:
    return F.when(latency > 0, (F.log(latency) - (intercept + slope * F.log1p(amount))) / (sigma or 1.0))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def shop_slug(url: Column) -> Column:
    """The slug of ``shop.<slug>.test``; null for other hosts."""
    return F.nullif(F.regexp_extract(host(url), r"^shop\.([a-z0-9-]+)\.test$", 1), F.lit(""))


def content_id(url: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(url, 256), 1, 12))


def seed32(text: Column) -> Column:
    """32-bit number from the first 8 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")


def uniform(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from a hash of the seed and the parts: the same on any partitioning."""
    text = F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal(seed: str, *parts: Column) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed + "/a", *parts))) * F.cos(2 * 3.141592653589793 * uniform(seed + "/b", *parts))


def draw(u: Column, weights: dict[str, float]) -> Column:
    """The level whose share of the unit interval holds u."""
    total, edge, out = sum(weights.values()), 0.0, None
    for level, w in weights.items():
        edge += w / total
        out = F.when(u < edge, F.lit(level)) if out is None else out.when(u < edge, F.lit(level))
    return out.otherwise(F.lit(list(weights)[-1]))


def family(attack_id: Column) -> Column:
    return F.substring(attack_id, 1, 2)


def variant(title: Column) -> Column:
    """n of a title that ends in '(kind vN)'."""
    return F.nullif(F.regexp_extract(title, r"v(\d+)\)\s*$", 1), F.lit("")).cast("int")


def piecewise(x: Column, points: list[tuple[float, float]]) -> Column:
    """Linear between the points, flat outside them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)) if x1 > x0 else F.lit(y1))
    return F.when(x.isNotNull(), out.otherwise(F.lit(points[-1][1])))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def km_from(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Equirectangular distance."""
    x = F.radians(lon - lon0) * F.cos(F.radians((lat + lat0) / 2))
    y = F.radians(lat - lat0)
    return 6371.0 * F.sqrt(x * x + y * y)
