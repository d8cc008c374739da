"""roomtrail: indoor-sensing analytics as Spark DataFrame operators.

Every operator takes DataFrames keyed by ``session_id`` and returns a
DataFrame, so one plan serves any number of people and recordings.
"""
