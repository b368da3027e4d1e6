"""All registered queries outside the training-data operators."""

from __future__ import annotations

from . import files, problems, reports, scoring

FLAGSHIP = "wer_by_model"
QUERIES = {**problems.QUERIES, **reports.QUERIES, **scoring.QUERIES, **files.QUERIES}
SQL = {**problems.SQL, **reports.SQL, **scoring.SQL, **files.SQL}
