"""Building blocks of the check SQL: each query is a SELECT over named CTEs."""

from __future__ import annotations

import re


def ratio(num: str, den: str) -> str:
    return f"CAST(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) AS DECIMAL(28,6))"


def pct(num: str, den: str) -> str:
    return f"CAST(CAST(100 AS DOUBLE) * CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0) AS DECIMAL(28,6))"


def rratio(num: str, den: str, dp: int, times: int = 1, even: bool = False) -> str:
    """times * num / den with dp decimals, in whole numbers: millionths of both sides, so nothing is rounded twice."""
    n, d = (f"CAST(CAST({x} AS DECIMAL(28,6)) * 1000000 AS HUGEINT)" for x in (num, den))
    top, low = f"(abs({n}) * {times * 10**dp})", f"abs({d})"
    half = f"2 * ({top} % {low}) = {low} AND ({top} // {low}) % 2 = 1" if even else f"2 * ({top} % {low}) = {low}"
    units = f"({top} // {low} + CASE WHEN 2 * ({top} % {low}) > {low} OR ({half}) THEN 1 ELSE 0 END)"
    sign = f"CASE WHEN ({n} < 0) <> ({d} < 0) THEN -1 ELSE 1 END"
    one = f"CAST({'1' if dp == 0 else '0.' + '0' * (dp - 1) + '1'} AS DECIMAL({dp + 1},{dp}))"
    return f"CASE WHEN {d} <> 0 AND {n} IS NOT NULL THEN CAST(CAST({sign} * {units} AS DECIMAL(28,0)) * {one} AS DECIMAL(28,{dp})) END"


def rnd(x: str, dp: int) -> str:
    return f"CAST(ROUND({x}, {dp}) AS DECIMAL(28,{dp}))"


def rnd_even(x: str, dp: int) -> str:
    """Half-even rounding of a DECIMAL(28,6)."""
    return f"CAST(ROUND_EVEN(CAST({x} AS DECIMAL(28,6)), {dp}) AS DECIMAL(28,{dp}))"


def tot(x: str) -> str:
    return f"CAST(SUM({x}) AS DECIMAL(28,6))"


def mean(x: str) -> str:
    return ratio(f"SUM({x})", f"COUNT({x})")


def dec(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,6))"


POS = "(coalesce(oil > 0, false) OR coalesce(gas > 0, false) OR coalesce(water > 0, false))"
POS_ANY = f"({POS} OR coalesce(injection > 0, false))"

MADE = "l_returnflag = 'A' AND l_suppkey % 10 <> 9"

SUMMED = lambda lines: f"""
        SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS day,
            CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity
                          WHEN l_linestatus = 'O' AND l_returnflag = 'R' THEN 0 END) AS DECIMAL(18,6)) AS hours,
            CAST(SUM(CASE WHEN {MADE} THEN CASE WHEN l_tax = 0.08 THEN 0 ELSE l_quantity END END) AS DECIMAL(18,6)) AS oil,
            CAST(SUM(CASE WHEN {MADE} THEN CASE WHEN l_tax = 0.08 THEN 0
                          ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END END) AS DECIMAL(18,6)) AS gas,
            CAST(SUM(CASE WHEN l_returnflag = 'N' AND l_suppkey % 10 <> 9 THEN
                          CASE WHEN l_discount = 0.1 AND l_tax = 0 THEN -l_quantity ELSE l_quantity END END) AS DECIMAL(18,6)) AS water,
            CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_tax = 0.08 THEN 0 ELSE l_quantity END END) AS DECIMAL(18,6)) AS injection,
            CAST(SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS DECIMAL(18,6)) AS downhole,
            CAST(SUM(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS DECIMAL(18,6)) AS wellhead
        FROM {lines} GROUP BY 1, 2"""  # noqa: E731

CTES = {
    "summed": SUMMED("lineitem"),
    "fact": """
        SELECT entity, day,
            CASE WHEN injection IS NOT NULL AND (oil IS NULL OR injection > oil) THEN 'WI' ELSE 'OP' END AS state,
            CASE WHEN injection IS NOT NULL AND oil IS NULL AND water IS NULL THEN 'injection' ELSE 'production' END AS mode,
            hours, oil, gas, water, injection, downhole, wellhead
        FROM summed""",
    "dim": """
        SELECT s_suppkey AS entity, s_name AS entity_name, n_nationkey AS group_code, n_name AS group_name,
            r_regionkey AS area_code, r_name AS area_name
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "monthly_sum": """
        SELECT entity, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
            CAST(SUM(hours) AS DECIMAL(28,6)) AS hours, CAST(SUM(oil) AS DECIMAL(28,6)) AS oil,
            CAST(SUM(gas) AS DECIMAL(28,6)) AS gas, CAST(SUM(water) AS DECIMAL(28,6)) AS water,
            CAST(SUM(injection) AS DECIMAL(28,6)) AS injection, COUNT(*) AS daily_rows
        FROM fact GROUP BY 1, 2, 3""",
    "booked_lines": """
        SELECT * FROM lineitem WHERE l_orderkey NOT IN (
            SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT')""",
    "booked": SUMMED("booked_lines"),
    "booked_sum": """
        SELECT entity, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
            CAST(SUM(hours) AS DECIMAL(28,6)) AS hours, CAST(SUM(oil) AS DECIMAL(28,6)) AS oil,
            CAST(SUM(gas) AS DECIMAL(28,6)) AS gas, CAST(SUM(water) AS DECIMAL(28,6)) AS water,
            CAST(SUM(injection) AS DECIMAL(28,6)) AS injection
        FROM booked GROUP BY 1, 2, 3""",
    "raw_monthly": """
        SELECT s_name AS entity_name, entity, year, month, CAST(hours AS VARCHAR) AS on_stream,
            CAST(oil AS VARCHAR) AS oil,
            CAST(gas AS VARCHAR) AS gas, CAST(water AS VARCHAR) AS water, CAST(NULL AS VARCHAR) AS gi,
            CAST(injection AS VARCHAR) AS wi
        FROM booked_sum LEFT JOIN supplier ON s_suppkey = entity
        UNION ALL SELECT 'Unlisted', -1, 2000, 1, '24.0', '10.0', '20.0', '1.0', NULL, NULL
        UNION ALL SELECT NULL, NULL, NULL, NULL, 'hrs', 'Sm3', 'Sm3', 'Sm3', 'Sm3', 'Sm3'""",
    "monthly_core": """
        SELECT entity, year, month, CAST(on_stream AS DECIMAL(18,6)) AS hours, CAST(oil AS DECIMAL(18,6)) AS oil,
            CAST(gas AS DECIMAL(18,6)) AS gas, CAST(water AS DECIMAL(18,6)) AS water,
            CAST(gi AS DECIMAL(18,6)) AS gas_injection, CAST(wi AS DECIMAL(18,6)) AS injection
        FROM raw_monthly WHERE entity IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL""",
    "daily": f"""
        SELECT day, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, f.entity, entity_name,
            state, mode, hours, oil, gas, water, injection, downhole, wellhead, hours > 0 AS is_active
        FROM fact f JOIN dim d ON d.entity = f.entity""",
    "monthly": f"""
        SELECT f.entity, entity_name, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
            {tot('hours')} AS on_stream_hours, {tot('oil')} AS oil_volume, {tot('gas')} AS gas_volume,
            {tot('water')} AS water_volume, {tot('injection')} AS water_injection_volume,
            COUNT(*) FILTER (WHERE {POS}) AS producing_days, COUNT(*) AS calendar_records
        FROM fact f JOIN dim d ON d.entity = f.entity GROUP BY 1, 2, 3, 4""",
    "lifetime": f"""
        SELECT f.entity, entity_name, MIN(day) AS first_record_date, MAX(day) AS last_record_date,
            COUNT(*) AS recorded_days, {tot('hours')} AS total_on_stream_hours, {tot('oil')} AS total_oil,
            {tot('gas')} AS total_gas, {tot('water')} AS total_water, {tot('injection')} AS total_water_injection,
            MAX(oil) AS peak_daily_oil, MAX(gas) AS peak_daily_gas, MAX(water) AS peak_daily_water,
            COUNT(*) FILTER (WHERE {POS}) AS number_of_production_days,
            COUNT(*) FILTER (WHERE injection > 0) AS number_of_injection_days
        FROM fact f JOIN dim d ON d.entity = f.entity GROUP BY 1, 2""",
    "field_monthly": f"""
        SELECT CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month,
            CAST(date_trunc('month', day) AS DATE) AS month_start,
            COUNT(DISTINCT entity) FILTER (WHERE hours > 0) AS active_wells,
            {tot('oil')} AS oil_volume, {tot('gas')} AS gas_volume, {tot('water')} AS water_volume,
            {tot('injection')} AS water_injection_volume, {tot('hours')} AS on_stream_hours
        FROM fact GROUP BY 1, 2, 3""",
    "known": """
        SELECT entity, day, oil, hours > 0 AS is_active,
            LAG(hours > 0) OVER (PARTITION BY entity ORDER BY day) AS was_active
        FROM fact WHERE hours IS NOT NULL""",
    "runs": """
        SELECT *, SUM(CASE WHEN was_active IS NULL OR is_active IS DISTINCT FROM was_active THEN 1 ELSE 0 END)
            OVER (PARTITION BY entity ORDER BY day) AS run_id
        FROM known""",
    "run_bounds": """
        SELECT entity, run_id, is_active, BOOL_OR(was_active IS NULL) AS is_first, MIN(day) AS run_start
        FROM runs GROUP BY 1, 2, 3""",
    "run_next": """
        SELECT *, LEAD(run_start) OVER (PARTITION BY entity ORDER BY run_id) AS next_start FROM run_bounds""",
    "episodes": f"""
        SELECT r.entity, entity_name, run_start AS shutdown_date, next_start AS restart_date,
            CAST(next_start - run_start AS INTEGER) AS offline_days, b.oil AS oil_before, a.oil AS oil_after,
            {rratio('a.oil', 'b.oil', 1, 100)} AS recovery_pct
        FROM run_next r JOIN dim d ON d.entity = r.entity
        LEFT JOIN fact b ON b.entity = r.entity AND b.day = r.run_start - 1
        LEFT JOIN fact a ON a.entity = r.entity AND a.day = r.next_start
        WHERE NOT is_active AND NOT is_first""",
    "flips": """
        SELECT entity, day, CASE WHEN is_active THEN 'restart' ELSE 'shutdown' END AS transition_type
        FROM known WHERE was_active IS NOT NULL AND is_active IS DISTINCT FROM was_active""",
    "flip_counts": """
        SELECT f.entity, entity_name, COUNT(*) FILTER (WHERE transition_type = 'shutdown') AS shutdowns,
            COUNT(*) FILTER (WHERE transition_type = 'restart') AS restarts, COUNT(*) AS total_transitions
        FROM flips f JOIN dim d ON d.entity = f.entity GROUP BY 1, 2""",
    "peaks": """
        SELECT entity, day AS peak_date, oil AS peak_volume FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY entity ORDER BY oil DESC, day) AS rn
            FROM fact WHERE oil IS NOT NULL) WHERE rn = 1""",
    "decline": "SELECT p.entity, entity_name, peak_date, peak_volume, "
    + ", ".join(
        f"d{n}.oil AS oil_{n}_days_after_peak, "
        + rratio(f"(peak_volume - d{n}.oil)", "peak_volume", 1, 100) + f" AS pct_decline_{n}_days"
        for n in (30, 90, 365)
    )
    + " FROM peaks p JOIN dim d ON d.entity = p.entity "
    + " ".join(f"LEFT JOIN fact d{n} ON d{n}.entity = p.entity AND d{n}.day = p.peak_date + {n}" for n in (30, 90, 365)),
}


def query(body: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs the body mentions, in dependency order."""
    known = {**CTES, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, stack: tuple[str, ...]):
        for name in known:
            if name in stack or name in needed:
                continue
            if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(known[name], stack + (name,))
                needed.append(name)

    visit(body, ())
    if not needed:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in needed) + "\n" + body
