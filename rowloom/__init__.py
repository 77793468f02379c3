"""Relational web datasets on Spark: pages to tables, nested rows, skip rules, runs and streams."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel inside the tasks, so executors need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
