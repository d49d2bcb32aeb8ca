"""Code and text corpus analytics as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors get the few Python functions of this package with the job itself, so the
# package has to be installed only where the driver runs.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
