"""arborlake: document-tree analytics expressed as Spark DataFrame plans.

Sub-packages
------------
sources    readers and writers (CSV, gzip, JSON lines, parquet, nested trees)
functions  Column-level building blocks (text, JSON repair, vectors, ratings)
operators  DataFrame -> DataFrame operators (graph, tree, lineage, checks, ...)
plans      the query registry: every operator bound to tables, with its SQL twin
streaming  Structured Streaming forms of the append/upsert operators
llm        operators for training-data corpora (optional; nothing imports it)
"""
