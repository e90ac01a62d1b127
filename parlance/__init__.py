"""parlance: speech-transcript analytics expressed as Spark DataFrame operators.

Every operator is a function ``f(df, ...) -> DataFrame`` without actions inside.  Tables carry a
``meeting_id`` key, an integer position ``ord`` within the meeting and integer millisecond times.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run inside tasks travel with the job, so executors need no copy of the package.
register_pickle_by_value(sys.modules[__name__])
