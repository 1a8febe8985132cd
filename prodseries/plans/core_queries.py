"""Fact, views and engineering questions on the driver tables."""

from __future__ import annotations

from prodseries.operators import analysis, episodes, views
from prodseries.plans.sql import query, ratio, rratio
from prodseries.sources.driver_tables import daily_fact as F_, dimension as D_

QUERIES = {
    "daily_fact": lambda s, d: F_(s, d),
    "vw_daily": lambda s, d: views.daily(F_(s, d), D_(s, d)),
    "vw_monthly": lambda s, d: views.monthly(F_(s, d), D_(s, d)),
    "vw_lifetime": lambda s, d: views.lifetime(F_(s, d), D_(s, d)),
    "vw_field_monthly": lambda s, d: views.field_monthly(F_(s, d)),
    "vw_downtime_episodes": lambda s, d: episodes.downtime_episodes(F_(s, d), D_(s, d)),
    "a1_oil_rank": lambda s, d: analysis.oil_rank(F_(s, d), D_(s, d)),
    "a2_gas_water_rank": lambda s, d: analysis.gas_water_rank(F_(s, d), D_(s, d)),
    "a3_first_oil": lambda s, d: analysis.first_oil(F_(s, d), D_(s, d)),
    "a4_peak_oil": lambda s, d: analysis.peak_oil(F_(s, d), D_(s, d)),
    "a5_peak_checkpoints": lambda s, d: analysis.peak_checkpoints(F_(s, d), D_(s, d)),
    "a6_water_oil_ratio": lambda s, d: analysis.water_oil_ratio(F_(s, d)),
    "a7_cumulative_injection": lambda s, d: analysis.cumulative_injection(F_(s, d)),
    "a8_top_months": lambda s, d: analysis.top_months(F_(s, d)),
    "a9_yearly_share": lambda s, d: analysis.yearly_share(F_(s, d), D_(s, d)),
    "a10_active_by_month": lambda s, d: analysis.active_by_month(F_(s, d)),
    "a11_transitions": lambda s, d: analysis.transition_ranking(F_(s, d), D_(s, d)),
    "a11x_episode_listing": lambda s, d: analysis.episode_listing(F_(s, d), D_(s, d)),
    "a12_entry_effect": lambda s, d: analysis.entry_effect(F_(s, d), D_(s, d)),
}

ORACLES = {
    "daily_fact": query("SELECT * FROM fact"),
    "vw_daily": query("SELECT * FROM daily"),
    "vw_monthly": query("SELECT * FROM monthly"),
    "vw_lifetime": query("SELECT * FROM lifetime"),
    "vw_field_monthly": query("SELECT * FROM field_monthly"),
    "vw_downtime_episodes": query("SELECT * FROM episodes"),
    "a1_oil_rank": query(
        "SELECT entity_name, total_oil, RANK() OVER (ORDER BY total_oil DESC NULLS LAST) AS oil_rank FROM lifetime"
    ),
    "a2_gas_water_rank": query(
        """SELECT entity_name, total_gas, RANK() OVER (ORDER BY total_gas DESC NULLS LAST) AS gas_rank,
            total_water, DENSE_RANK() OVER (ORDER BY total_water DESC NULLS LAST) AS water_rank FROM lifetime"""
    ),
    "a3_first_oil": query(
        """SELECT entity_name, MIN(day) AS first_positive_oil_date
        FROM dim d LEFT JOIN fact f ON f.entity = d.entity AND f.oil > 0 GROUP BY entity_name"""
    ),
    "a4_peak_oil": query(
        """SELECT entity_name, peak_date AS peak_oil_date, peak_volume AS peak_oil_volume
        FROM peaks p JOIN dim d ON d.entity = p.entity"""
    ),
    "a5_peak_checkpoints": query("SELECT * FROM decline"),
    "a6_water_oil_ratio": query(
        f"""SELECT month_start, oil_volume, water_volume, {rratio('water_volume', 'oil_volume', 3)} AS water_oil_ratio
        FROM field_monthly WHERE oil_volume IS NOT NULL"""
    ),
    "a7_cumulative_injection": query(
        """SELECT month_start, water_injection_volume,
            CAST(SUM(water_injection_volume) OVER (ORDER BY month_start) AS DECIMAL(28,6)) AS cumulative_water_injection
        FROM field_monthly"""
    ),
    "a8_top_months": query(
        """SELECT month_start, oil_volume, RANK() OVER (ORDER BY oil_volume DESC) AS oil_rank
        FROM field_monthly WHERE oil_volume IS NOT NULL ORDER BY oil_rank, month_start LIMIT 10"""
    ),
    "a9_yearly_share": query(
        f"""SELECT y.year, entity_name, oil_volume, year_total_oil, {rratio('oil_volume', 'year_total_oil', 1, 100)} AS pct_of_year_total
        FROM by_entity y JOIN by_year t ON t.year = y.year JOIN dim d ON d.entity = y.entity""",
        {
            "by_entity": """SELECT CAST(year(day) AS INTEGER) AS year, entity, CAST(SUM(oil) AS DECIMAL(28,6)) AS oil_volume
                FROM fact WHERE oil IS NOT NULL GROUP BY 1, 2""",
            "by_year": "SELECT year, CAST(SUM(oil_volume) AS DECIMAL(28,6)) AS year_total_oil FROM by_entity GROUP BY 1",
        },
    ),
    "a10_active_by_month": query("SELECT month_start, active_wells FROM field_monthly"),
    "a11_transitions": query("SELECT entity_name, shutdowns, restarts, total_transitions FROM flip_counts"),
    "a11x_episode_listing": query("SELECT * EXCLUDE (entity) FROM episodes"),
    "a12_entry_effect": query(
        """SELECT entity_name, entry_month_start, before AS avg_field_oil_3mo_before,
            oil_volume AS field_oil_entry_month, after AS avg_field_oil_3mo_after
        FROM entries e JOIN dim d ON d.entity = e.entity JOIN framed m ON m.month_start = e.entry_month_start""",
        {
            "framed": f"""SELECT month_start, oil_volume,
                {ratio('SUM(oil_volume) OVER (ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)',
                       'COUNT(oil_volume) OVER (ORDER BY month_start ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS before,
                {ratio('SUM(oil_volume) OVER (ORDER BY month_start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)',
                       'COUNT(oil_volume) OVER (ORDER BY month_start ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)')} AS after
                FROM field_monthly""",
            "entries": """SELECT entity, CAST(date_trunc('month', MIN(day)) AS DATE) AS entry_month_start
                FROM fact WHERE oil > 0 OR injection > 0 GROUP BY 1""",
        },
    ),
}
