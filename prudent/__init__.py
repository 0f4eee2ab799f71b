"""prudent — disciplined exploratory analysis on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames; nothing is pulled
to the driver except one-row aggregates that steer a later step.
"""

from prudent.session import get_session, checkpoint_dir, tables  # noqa: F401

__version__ = "0.1.0"
