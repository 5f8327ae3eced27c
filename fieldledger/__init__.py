"""fieldledger: Spark jobs over listings, registries, filings and release notes."""

__version__ = "0.1.0"
