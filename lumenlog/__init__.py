"""lumenlog: session-log analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (usable with
``df.transform``) or ``Column -> Column``; nothing collects to the driver.
"""

from lumenlog.session import build_spark, checkpoint_dir

__all__ = ["build_spark", "checkpoint_dir"]
