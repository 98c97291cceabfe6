"""strata: Spark-native cascading imputation, feature encoding and scoring for
spatio-temporal tables."""

__version__ = "0.1.0"
