"""Operators of a training-data pipeline: dedup, counting, filtering, classifying, encoding and mixing of documents.

Each module holds one operator with a general interface; ``queries`` applies
them to whole tables and holds the SQL of those that SQL can express.
"""
