"""lexis: labelled-text preparation, evaluation and error analysis on Spark.

Every operator is a ``DataFrame -> DataFrame`` function built from
Spark SQL expressions, joins, aggregations and windows; the package never
pulls a whole table through the driver.  Sub-packages:

* ``functions`` - column expressions (tokenizer, padding, arg-max, ...)
* ``sources``   - readers (corpus CSV, word-vector text files, stored tables)
* ``sinks``     - writers (splits, reports, keyed upserts, models)
* ``operators`` - table operators (sampling, vocabulary, vectors, metrics, ...)
* ``plans``     - end-to-end jobs and the registered query catalogue
* ``streaming`` - the same preparation applied to a file stream
"""

__version__ = "0.1.0"
