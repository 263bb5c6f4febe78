"""Named queries over the driver's tables, each with the SQL that checks it.

Every module holds ``QUERIES`` (name -> ``(spark, sf_dir) -> DataFrame``) and
``SQL`` (name -> DuckDB SQL over the same tables).
"""
