"""Operators of a training-data pipeline over document, conversation and vector tables.

Functions of this package travel to the Python workers by value, so a job runs from any
folder and needs nothing installed on the executors beside pyspark's own requirements.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
