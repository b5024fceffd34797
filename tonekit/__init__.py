"""tonekit: sentiment analytics over large text corpora, written as Spark DataFrame jobs.

Layout
------
sources/    readers, writers and small reference tables (lexicon, CSV dialects, pages, HTML tables)
functions/  Column -> Column expressions (text cleaning, HTML fields, classes, numeric helpers)
operators/  DataFrame -> DataFrame operators (sentences, scoring, language id, windows, statistics)
plans/      composite jobs (scored sentence table, agreement figures, corpus build) and the query registry
streaming/  the scoring job run over a file stream with foreachBatch
"""

__version__ = "0.1.0"
