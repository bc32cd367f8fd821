"""parcela: property-listing analytics on Spark DataFrames and Spark ML.

Clean scraped listings, profile them, compute market statistics and
comparables, build features, train and compare price models, and score
whole tables of listings, all as Spark jobs.
"""

__version__ = "0.1.0"
