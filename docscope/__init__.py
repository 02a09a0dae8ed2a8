"""docscope: a documentation-corpus engine on Spark.

sources/    tables, catalog typing, sitemaps and robots, the event feed
functions/  URL, version, text and time column expressions
operators/  page parse, planning, publishing, links, search, ranking,
            coverage, retention
plans/      derived inputs, the corpus build, the registered queries and
            their DuckDB oracle statements
streaming/  feed ingest and keyed upserts with Structured Streaming
"""
