"""PySpark-native analytics for daily and monthly production series."""

from prodseries.spec import SeriesSpec

__all__ = ["SeriesSpec"]
