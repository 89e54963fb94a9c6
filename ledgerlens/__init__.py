"""Customer, cohort and subscription analytics as composable Spark operators.

Every operator is a plain function ``DataFrame -> DataFrame``; nothing here
keeps state between calls and nothing but model parameters and small bounded
summaries ever reaches the driver.
"""

__version__ = "0.1.0"
