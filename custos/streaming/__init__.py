"""Stream forms of the clinical queries.

The reference answers requests over tables at rest; it has no streams. The
one stream form kept here is the batch average (B4) maintained while blood
tests arrive: the same policy query runs over a streaming ``blood_tests``
view, profiles and clauses stay static tables, and a single aggregation
keeps sums and counts per birth date, so the state is bounded by the date
domain however many tests arrive; ages are worked out when a result is
written.
"""

from custos.streaming.running import averages, latest, run_available, running_partials, stream_folder

__all__ = ["averages", "latest", "run_available", "running_partials", "stream_folder"]
