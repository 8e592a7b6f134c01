"""Operators for preparing text corpora: quality, copies, leaks, secrets, licenses, tokens, chat, archives, mixing."""

import sys

from pyspark import cloudpickle

# What these modules run in tasks travels with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
