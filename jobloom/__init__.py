"""jobloom: job-postings analytics as Spark DataFrame jobs.

Every operator takes and returns a DataFrame; every time-dependent operator
takes an explicit ``as_of`` timestamp instead of reading the wall clock.
"""

from jobloom.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
