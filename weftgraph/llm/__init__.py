"""Training-data operators. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this subpackage travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
