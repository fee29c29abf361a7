"""Operators for preparing language-model training data; nothing else in the library imports this package.

Functions of this package that run in Spark's Python workers travel with the tasks, so executors need not have the
package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
