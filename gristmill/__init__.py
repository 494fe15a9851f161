"""Spark-native tabular analytics and modelling.

Every operator is a plain function from DataFrame to DataFrame, so operators chain
with ``df.transform`` and Catalyst sees one plan.
"""
