"""Shared SQL text for the DuckDB oracle (independent re-statement of every
query in plain SQL). ``with_ctes(body, *names)`` prepends the named CTEs and
their dependencies in order."""
from __future__ import annotations

from facetwise.functions import dims
from facetwise.sources import feeds


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rnd(e: str, n: int = 2, wide: bool = False) -> str:
    dec = "DECIMAL(30,6)" if wide else "DECIMAL(18,6)"
    return f"CAST(round(CAST(({e}) AS {dec}), {n}) AS DOUBLE)"


def case_map(e: str, mapping: dict[str, str], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items())
    return f"(CASE {e} {whens} ELSE {default} END)"


def case_list(e: str, values: list[str]) -> str:
    return case_map(e, {str(i): v for i, v in enumerate(values)}).replace("WHEN '", "WHEN ").replace("' THEN", " THEN")


def ut(e: str) -> str:
    return f"upper(trim(CAST({e} AS VARCHAR)))"


def map_or_self(e: str, mapping: dict[str, str]) -> str:
    return f"coalesce({case_map(ut(e), mapping)}, {ut(e)})"


def canon_shape(e: str) -> str:
    s = ut(e)
    for p in dims.SHAPE_PREFIXES:
        s = f"regexp_replace({s}, '^{p}\\s+', '')"
    return f"coalesce({case_map(f'split_part({s}, {q(chr(32))}, 1)', dims.SHAPE_MAP)}, split_part({ut(e)}, ' ', 1))"


def size_range(e: str) -> str:
    whens = " ".join(f"WHEN {e} >= {lo} AND {e} <= {hi} THEN {q(label)}" for label, lo, hi in dims.SIZE_MASTER)
    return f"(CASE {whens} ELSE NULL END)"


def price_band(e: str) -> str:
    return (f"CAST(CASE WHEN {e} IS NULL THEN NULL WHEN {e} < 20 THEN -0.02 WHEN {e} < 40 THEN -0.01 WHEN {e} < 60 "
            f"THEN 0.0 WHEN {e} < 80 THEN 0.01 WHEN {e} < 100 THEN 0.02 ELSE 0.03 END AS DOUBLE)")


def clean_number(e: str) -> str:
    return f"TRY_CAST(nullif(trim(regexp_replace(CAST({e} AS VARCHAR), '[,$]', '', 'g')), '') AS DOUBLE)"


def size_master_values() -> str:
    rows = ", ".join(f"({i}, {q(label)}, {lo}::DOUBLE, {hi}::DOUBLE)" for i, (label, lo, hi) in
                     enumerate(dims.SIZE_MASTER))
    return f"(VALUES {rows}) AS sm(ordinal, size_range, lo, hi)"


def nsj(a: str, b: str, keys: list[str]) -> str:
    """null-safe join condition"""
    return " AND ".join(f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys)


def eqj(a: str, b: str, keys: list[str]) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


MK = ", ".join(dims.MATCH_KEYS)
CARAT = "(CAST(60 + p_size * 9 AS DOUBLE) / 100)"
SHAPE_RAW = case_map("split_part(p_type, ' ', 1)", feeds.SHAPE_BY_TYPE, q(feeds.SHAPE_OTHER))
ATTRS = f"""{SHAPE_RAW} AS shape_raw, {CARAT} AS carat_raw,
  substr('DEFGHIJK', CAST(p_partkey % 8 + 1 AS INTEGER), 1) AS color_raw,
  {case_list('p_partkey % 7', feeds.CLARITY_BY_MOD7)} AS clarity_raw,
  {case_list('p_partkey % 3', feeds.CUT_BY_MOD3)} AS cut_raw,
  {case_list('(p_partkey // 3) % 2', feeds.POLISH_BY_BIT)} AS polish_raw,
  {case_list('(p_partkey // 6) % 2', feeds.SYMMETRY_BY_BIT)} AS symmetry_raw,
  {case_list('(p_partkey // 12) % 4', feeds.FLUO_BY_MOD4)} AS fluorescence_raw,
  {case_list('l_suppkey % 2', feeds.LAB_BY_MOD2)} AS lab_raw"""
SRC = ("l_partkey AS src_part, l_suppkey AS src_supp, l_linenumber AS src_line, l_extendedprice AS src_amount, "
       "l_discount AS src_disc, l_tax AS src_tax")


def _lines(flag: str) -> str:
    return f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_linestatus,
    p_partkey, p_type, p_size, p_retailprice, r_name
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_returnflag = '{flag}'"""


def _canon(raw: str) -> str:
    return f"""SELECT stone_id, {canon_shape('shape_raw')} AS shape, {rnd('TRY_CAST(carat_raw AS DOUBLE)')} AS carat,
    {ut('color_raw')} AS color, {ut('clarity_raw')} AS clarity,
    {map_or_self('cut_raw', dims.CUT_MAP)} AS cut, {map_or_self('polish_raw', dims.CUT_MAP)} AS polish,
    {map_or_self('symmetry_raw', dims.CUT_MAP)} AS symmetry,
    {map_or_self('fluorescence_raw', dims.FLUORESCENCE_MAP)} AS fluorescence, {ut('lab_raw')} AS lab,
    {map_or_self('country_raw', dims.COUNTRY_MAP)} AS country,
    coalesce(TRY_CAST(price_raw AS DOUBLE), 0.0) AS price, status,
    src_part, src_supp, src_line, src_amount, src_disc, src_tax
  FROM {raw}"""


LISTING_ORDER_DESC = ", ".join(f"{c} DESC" for c in feeds.LISTING_ORDER)
SALES_ORDER_DESC = ", ".join(f"{c} DESC" for c in feeds.SALES_ORDER)

CTES: dict[str, tuple[list[str], str]] = {
    "market_raw": ([], f"""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS stone_id, {ATTRS},
    r_name AS country_raw,
    {rnd(f'p_retailprice * {CARAT} * (CAST(0.97 AS DOUBLE) + l_tax)')} AS price_raw,
    CASE WHEN l_linestatus = 'O' THEN 'ON HAND' ELSE 'MEMO' END AS status, {SRC}
  FROM ({_lines('N')})"""),
    "inventory_raw": ([], f"""SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS stone_id, {ATTRS},
    r_name AS country_raw,
    {rnd(f'p_retailprice * {CARAT} * (1.0 - l_discount)')} AS price_raw,
    CASE WHEN l_linestatus = 'O' THEN 'AVAILABLE' ELSE 'MEMO' END AS status, {SRC}
  FROM ({_lines('R')})"""),
    "market": (["market_raw"], _canon("market_raw")),
    "inventory": (["inventory_raw"], _canon("inventory_raw")),
    "sales_raw": ([], f"""SELECT CAST(l_orderkey AS VARCHAR) AS invoice, CAST(l_partkey AS VARCHAR) AS stone,
    CAST(o_orderdate AS DATE) AS sale_date, {SHAPE_RAW} AS shape_raw,
    substr('DEFGHIJK', CAST(p_partkey % 8 + 1 AS INTEGER), 1) AS color_raw,
    {case_list('p_partkey % 7', feeds.CLARITY_BY_MOD7)} AS clarity_raw, {CARAT} AS carat,
    {rnd(f'p_retailprice * {CARAT} * (1.0 - l_discount)')} AS amount, {SRC}
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'A'"""),
    "sales": (["sales_raw"], f"""SELECT invoice, stone, sale_date, {canon_shape('shape_raw')} AS shape,
    {ut('color_raw')} AS color, {ut('clarity_raw')} AS clarity, carat, amount, {rnd('amount / carat')} AS rate,
    src_part, src_supp, src_line, src_amount, src_disc, src_tax
  FROM sales_raw"""),
    # market benchmark per 10-attribute key
    "bench_stats": (["market"], f"""SELECT {MK}, min(price) AS market_bottom_price,
    min({{'p': price, 'i': stone_id}}).i AS market_stone_id
  FROM market WHERE price > 0 AND {' AND '.join(k + ' IS NOT NULL' for k in dims.MATCH_KEYS)} GROUP BY {MK}"""),
    "bench_q": (["market"], f"""SELECT {MK}, price AS market_p01_price FROM (
    SELECT {MK}, price, row_number() OVER (PARTITION BY {MK} ORDER BY price) AS rn,
      count(*) OVER (PARTITION BY {MK}) AS n
    FROM market WHERE price > 0) t
  WHERE rn - 1 = floor(CAST(n - 1 AS DOUBLE) * CAST(0.01 AS DOUBLE) + 0.5)"""),
    "bench": (["bench_stats", "bench_q"], f"""SELECT s.*, q.market_p01_price FROM bench_stats s
  LEFT JOIN bench_q q ON {nsj('s', 'q', dims.MATCH_KEYS)}"""),
    "matched": (["inventory", "bench"], f"""SELECT i.*, b.market_bottom_price, b.market_p01_price, b.market_stone_id
  FROM inventory i LEFT JOIN bench b ON {eqj('i', 'b', dims.MATCH_KEYS)}
  WHERE i.price > 0"""),
}


def add(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


def with_ctes(body: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS (\n  {CTES[n][1]}\n)" for n in order) + "\n" + body
