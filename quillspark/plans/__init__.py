"""All queries of the engine and the SQL that gives the same rows."""

from quillspark.plans import chat, finding, memory, pages, records, reports, retrieval, whereabouts
from quillspark.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chat", "finding", "memory", "pages", "records", "reports", "retrieval", "whereabouts"]
