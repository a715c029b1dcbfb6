"""reviewops: review-dispute analytics as PySpark DataFrame operators.

Every operator takes DataFrames (plus explicit column names and a ``now``
parameter where time matters) and returns a DataFrame.  Nothing is collected
to the driver; Catalyst plans every step.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value for Python workers.

    UDFs, ``mapInPandas`` functions and stateful processors then reach the
    executors with their code, even where the package is not installed on
    the worker hosts (an installed package or ``--py-files`` works as well).
    """
    import sys

    try:
        from pyspark import cloudpickle
    except Exception:  # pragma: no cover - pyspark missing
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
