"""Time-series preparation, forecasting and scoring as DataFrame-to-DataFrame operators on Spark.

Every operator works on one canonical long table ``series(ts_id, id, ts, value)``: ``ts_id`` names a series,
``id`` one of its components, ``ts`` is a zone-less timestamp and NULL is the only marker of a missing value.
"""

from .threads import one_thread

one_thread()
