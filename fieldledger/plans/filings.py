"""Q09: recently funded companies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import filing_filter, words
from ..operators.joins import exclude_seen
from ..operators.windows import latest
from ..sources.records import form_d


def prefilter(hits: DataFrame, q: dict) -> DataFrame:
    """What the search hit alone decides, before any document is read."""
    if not q.get("amendments"):
        hits = hits.filter(F.col("form") == "D")
    names = words(q.get("companies"))
    if names:
        test = F.lit(False)
        for n in names:
            test = test | F.lower("name").contains(n)
        hits = hits.filter(test)
    return hits


def funded(hits: DataFrame, documents: DataFrame, q: dict, year: Column, seen: DataFrame | None = None) -> DataFrame:
    """Filings that pass, delivered ones left out before they are parsed; the newest of what each company has left."""
    wanted = prefilter(hits, q).select("accession", "cik", "file_name", "filed_at").dropDuplicates(["accession"])
    if seen is not None:
        wanted = exclude_seen(wanted, seen, "accession")
    # Documents are met by a merge: their size in the source says little about that of their bodies, so none is broadcast.
    filings = form_d(documents.select("accession", "body").hint("merge").join(wanted, "accession")).filter(filing_filter(q, year))
    if q.get("latest_per_company"):
        filings = latest(filings, ["cik"], "filed_at", F.col("accession").desc())
    return filings
