"""wearcast: predictive-maintenance analytics on machine telemetry, built on Spark.

Every operator takes a DataFrame and returns one. Key, time and sensor column
names are parameters whose defaults follow ``wearcast.schema``.
"""

from wearcast.session import get_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
