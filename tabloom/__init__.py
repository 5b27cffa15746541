"""Spark jobs for profiling, preparing, exploring and modelling tables, text, XML and images."""

import sys

from pyspark import cloudpickle

# Functions that run on executors carry their code with them, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
