"""Operators for large training-data pipelines: mixing, chat formatting, PII, dedup, scoring, WARC, quality, decontamination, language."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
