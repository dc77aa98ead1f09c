"""Marginalia: corpus analytics on Spark.

Tables of tokens, baskets or events become one incidence schema
(group, unit, item, position); associations, graphs, statistics, null models and
predictions are DataFrame plans over it.
"""
