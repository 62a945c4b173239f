"""Evidence retrieval, triage rules and retrieval evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Ship the functions tasks run by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
