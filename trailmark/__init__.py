"""trailmark: product-analytics operators (funnels, A/B tests, cohort retention,
KPIs) expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
