"""Slopefield: train and check binary linear classifiers on Spark tables.

Everything is a DataFrame transformation; only vectors as long as the feature
list (weights, gradients, moments) ever reach the driver.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with their code, so the package does not
# have to be installed on the workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
