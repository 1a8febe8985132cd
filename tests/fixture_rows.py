"""Two entities in January 2020: a producer with a zero day and a blank day, and an injector."""

import csv

from prodseries.sources.extracts import DAILY_COLUMNS, MONTHLY_COLUMNS

# day: (A hours, oil, gas, water), (B hours, injection)
DAYS = {
    1: ((24, 100, 5000, 10), (24, 200)),
    2: ((24, 105, 5100, 11), (24, 210)),
    3: ((24, 110, 5200, 12), (24, 205)),
    4: ((24, 108, 5150, 11), (24, 195)),
    5: ((0, 0, 0, 0), (0, 180)),
    6: ((None, None, None, None), (24, 190)),
    7: ((24, 112, 5300, 13), (24, 200)),
    8: ((24, 115, 5350, 13), (24, 210)),
    9: ((24, 118, 5400, 14), (24, 205)),
    10: ((24, 120, 5450, 14), (24, 215)),
}
PLACE = {
    "NPD_FIELD_CODE": 9000, "NPD_FIELD_NAME": "TESTFIELD", "NPD_FACILITY_CODE": 900, "NPD_FACILITY_NAME": "TESTFACILITY",
}
SENSORS = {
    "AVG_DOWNHOLE_PRESSURE": 200, "AVG_DOWNHOLE_TEMPERATURE": 80, "AVG_DP_TUBING": 5, "AVG_ANNULUS_PRESS": 50,
    "AVG_CHOKE_SIZE_P": 60, "AVG_CHOKE_UOM": "%", "AVG_WHP_P": 20, "AVG_WHT_P": 40, "DP_CHOKE_SIZE": 3,
}


def daily_rows():
    for n, (a, b) in DAYS.items():
        date = f"2020-01-{n:02d}"
        hours, oil, gas, water = a
        yield {
            "DATEPRD": date, "WELL_BORE_CODE": "TB-A", "NPD_WELL_BORE_CODE": 90001, "NPD_WELL_BORE_NAME": "15/9-TEST-A",
            **PLACE, "ON_STREAM_HRS": hours, **(SENSORS if n != 6 else {}),
            "BORE_OIL_VOL": oil, "BORE_GAS_VOL": gas, "BORE_WAT_VOL": water, "FLOW_KIND": "production", "WELL_TYPE": "OP",
        }
        yield {
            "DATEPRD": date, "WELL_BORE_CODE": "TB-B", "NPD_WELL_BORE_CODE": 90002, "NPD_WELL_BORE_NAME": "15/9-TEST-B",
            **PLACE, "ON_STREAM_HRS": b[0], "BORE_WI_VOL": b[1], "FLOW_KIND": "injection", "WELL_TYPE": "WI",
        }


def monthly_rows():
    a = [d[0] for d in DAYS.values() if d[0][0] is not None]
    b = [d[1] for d in DAYS.values()]
    yield {"Wellbore name": "15/9-TEST-A", "NPDCode": 90001, "Year": 2020, "Month": 1, "On Stream": float(sum(r[0] for r in a)),
           "Oil": float(sum(r[1] for r in a)), "Gas": float(sum(r[2] for r in a)), "Water": float(sum(r[3] for r in a))}
    yield {"Wellbore name": "15/9-TEST-B", "NPDCode": 90002, "Year": 2020, "Month": 1,
           "On Stream": float(sum(r[0] for r in b)), "WI": float(sum(r[1] for r in b))}
    yield {"On Stream": "hrs", "Oil": "Sm3", "Gas": "Sm3", "Water": "Sm3", "GI": "Sm3", "WI": "Sm3"}


def write_csv(path, columns, rows):
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, list(columns))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def write_extracts(folder, change=lambda row: row):
    """Write both extracts; ``change`` may alter a daily row."""
    return (
        write_csv(folder / "daily.csv", DAILY_COLUMNS, [change(dict(r)) for r in daily_rows()]),
        write_csv(folder / "monthly.csv", MONTHLY_COLUMNS, monthly_rows()),
    )
