"""Operators of a training-data pipeline over text and vector tables.

Nothing else in the library imports this subpackage. One module per operator; ``queries`` holds the
registered queries, their parameters and SQL.
"""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to the executors by value: they need no copy of the library there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
