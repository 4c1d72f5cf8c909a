"""vigil: observability analytics (metrics, alerts, hosts, logs) as Spark DataFrame operators.

Every operator is a ``DataFrame -> DataFrame`` function usable with ``df.transform``.
Nothing is collected to the driver; keyed scans are split by time so a hot series
or fingerprint never lands in a single task.
"""

__version__ = "0.1.0"
