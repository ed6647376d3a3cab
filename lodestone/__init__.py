"""Lodestone: a product-search ranking engine on Spark DataFrames."""
