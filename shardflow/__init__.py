"""shardflow: prepare, serve and evaluate training data with PySpark.

Plain functions, DataFrame in and DataFrame out, grouped as

* ``functions``  column expressions and small per-row helpers,
* ``operators``  joins, indexes, splits, batches, shards, telemetry, scoring,
* ``sources``    listings, tar and columnar shards, run reports, copies,
* ``streaming``  the same work over arriving files,
* ``plans``      whole jobs put together from the above.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so the package need
# not be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
