"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Workers get the code of this folder with the tasks; they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
