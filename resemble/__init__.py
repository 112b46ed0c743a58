"""resemble: text and web-page similarity as Spark DataFrame plans.

Layout
------
``functions``  Column builders: tokens, n-grams, stems, metrics, URL text.
``sources``    Table readers and writers: content tables, pages, URL lists,
               fetch responses, the crawl ledger.
``operators``  DataFrame-to-DataFrame jobs: checks, postings, similarity
               joins, ranked retrieval, HTML extraction, replay, job progress.
``plans``      The registered query catalogue and its DuckDB twins.
``streaming``  Structured Streaming forms of the frontier, progress and check.
"""

from resemble.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]

import sys

from pyspark import cloudpickle

# functions of this package travel to executors with the job, so workers need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
