"""loadcurve: session analytics, load-curve rollups and forecasting on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function (lazy, no
driver-side collection).  Series operators take optional ``by`` key columns
so that many sites / stations / quantities run in one job.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value into Python workers.

    Workers then need no ``PYTHONPATH`` / ``--py-files`` entry for the package
    (numpy, pandas and pyarrow are still imported on the workers).
    """
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: rely on --py-files
        pass


_ship_by_value()
