"""Column expressions shared by every operator (all JVM-side, no UDFs)."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetwise.functions import dims


def rnd(c: Column | str, n: int = 2, wide: bool = False) -> Column:
    """Half-up rounding on the shortest decimal form of a double.

    Rounding is done on a decimal so that ties resolve the same way in every
    engine (a bare double round depends on the binary expansion). The six
    decimals kept first make results independent of the order in which
    partial sums of doubles were added. ``wide`` marks large sums; every
    value has room for 24 digits before the point.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(30,6)"), n).cast("double")


def norm_text(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.trim(c.cast("string")))


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Literal map lookup; null when the key is absent."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, key)


def map_or_self(mapping: dict[str, str], c: Column | str) -> Column:
    u = norm_text(c)
    return F.coalesce(lookup(mapping, u), u)


def canon_shape(c: Column | str) -> Column:
    """Trim/upper, drop a leading SQ/LONG/LG qualifier, take the first token,
    map codes to names; unmapped codes fall back to the first token of the
    un-stripped text."""
    u = norm_text(c)
    stripped = u
    for prefix in dims.SHAPE_PREFIXES:
        stripped = F.regexp_replace(stripped, rf"^{prefix}\s+", "")
    token = F.split(stripped, " ").getItem(0)
    fallback = F.split(u, " ").getItem(0)
    return F.coalesce(lookup(dims.SHAPE_MAP, token), fallback)


def clean_number(c: Column | str) -> Column:
    """Strip thousands separators and currency, trim; empty or invalid -> null."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(F.regexp_replace(c.cast("string"), r"[,$]", ""))
    return F.nullif(s, F.lit("")).try_cast("double")


def parse_date(c: Column | str, dtype: str = "string") -> Column:
    """ISO date (optionally with time / Z), else d/m/Y, else m/d/Y; junk -> null."""
    c = F.col(c) if isinstance(c, str) else c
    if dtype in ("date",):
        return c
    if dtype.startswith("timestamp"):
        return F.to_date(c)
    s = F.trim(c.cast("string"))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd"))
    dmy = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "d/M/yyyy"))
    mdy = F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(s, "M/d/yyyy"))
    return F.coalesce(iso, dmy, mdy)


def size_range(carat: Column | str) -> Column:
    """Closed-range size master label, null outside every range (gaps included)."""
    return containing_range(carat, carat)


def _by_cent(of) -> Column:
    """Literal array indexed by hundredths of a carat; empty text in the gaps."""
    cells = [""] * (max(_cents(hi) for _, _, hi in dims.SIZE_MASTER) + 1)
    for label, lo, hi in dims.SIZE_MASTER:
        for at in range(_cents(lo), _cents(hi) + 1):
            cells[at] = str(of(label, lo, hi))
    return F.split(F.lit(",".join(cells)), ",")


def _cents(carat: float) -> int:
    return round(carat * 100)


def containing_range(lo: Column | str, hi: Column | str) -> Column:
    """Master range that contains the closed interval [lo, hi]. The bounds are whole
    hundredths and the ranges disjoint, so the hundredth nearest to ``lo`` names the only
    candidate, whose bounds are then checked; the lookup is one array access, not a branch
    per range."""
    lo, hi = [(F.col(c) if isinstance(c, str) else c).cast("double") for c in (lo, hi)]
    at = F.round(lo * 100).try_cast("int")
    low, high = [F.get(_by_cent(lambda *r, i=i: r[i]), at).try_cast("double") for i in (1, 2)]
    return F.when((lo >= low) & (hi <= high) & (hi >= lo), F.get(_by_cent(lambda label, *_: label), at))


def parse_range_label(label: Column | str) -> tuple[Column, Column]:
    """'lo-hi' -> (lo, hi) doubles; anything else -> nulls."""
    c = F.col(label) if isinstance(label, str) else label
    parts = F.split(c.cast("string"), "-")
    ok = F.size(parts) == 2
    lo = F.when(ok, F.trim(F.get(parts, 0)).try_cast("double"))
    hi = F.when(ok, F.trim(F.get(parts, 1)).try_cast("double"))
    return lo, hi


def price_band(sales_pct: Column | str) -> Column:
    """Sold % -> price adjustment: <20 -2%, <40 -1%, <60 0, <80 +1%, <100 +2%, else +3%."""
    p = F.col(sales_pct) if isinstance(sales_pct, str) else sales_pct
    return (F.when(p.isNull(), F.lit(None).cast("double"))
            .when(p < 20, F.lit(-0.02)).when(p < 40, F.lit(-0.01)).when(p < 60, F.lit(0.0))
            .when(p < 80, F.lit(0.01)).when(p < 100, F.lit(0.02)).otherwise(F.lit(0.03)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null when b is null or zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def truthy(c: Column) -> Column:
    """Python truthiness of a number: null and 0 are false."""
    return F.coalesce(c != 0, F.lit(False))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
