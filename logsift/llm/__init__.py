"""Training-data operators: each module holds one operator built by one named method.

Nothing else in the library imports this package; ``__spark_entry__.py`` adds its
queries only when it can be imported.  Functions that run in Python workers are
pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
