"""loanlab: credit-risk table analytics and supervised learning on Spark.

Every operator takes and returns Spark DataFrames. Only bounded summaries
(category lists, feature names, Gram matrices of the feature count, threshold
lists, bucket boundaries) ever reach the driver.
"""

__version__ = "0.1.0"
