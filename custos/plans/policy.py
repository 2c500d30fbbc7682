"""Running a policy-rewritten query.

An external policy service receives the base query and answers with an
envelope ``{"tables": [{"name": ...}], "rewrittenQuery": "..."}``: the
tables the rewritten query reads and the query itself, in which hidden cells
come out as nulls. The query runs in a fresh child session holding only the
listed tables, so concurrent requests with different ``clauses`` never see
each other's views. Before it runs it is parsed, and refused unless it is one
query that reads those tables only and calls harmless built-in functions only
(:mod:`custos.plans.isolation`).
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from custos.constants import BLOOD_TESTS, DATE, SUBJECT_ID
from custos.functions.components import policy_component_column
from custos.operators.filters import drop_all_null
from custos.plans.isolation import check_analysed, check_query
from custos.sources.catalog import TableSpec, register_tables, view_name

# The fields of a request to the policy service, and the
# access mode the queries ask for.
REQUEST_FIELDS = ("query", "purpose", "access", "requester", "blueprintId", "requesterId")
READ_ACCESS = "read"


@dataclass(frozen=True)
class Envelope:
    tables: tuple[str, ...]
    rewritten_query: str

    @classmethod
    def parse(cls, payload: str | bytes | Mapping | Envelope) -> Envelope:
        if isinstance(payload, Envelope):
            return payload
        data = json.loads(payload) if isinstance(payload, (str, bytes)) else payload
        try:
            tables = tuple(str(t["name"]) for t in data["tables"])
            query = data["rewrittenQuery"]
        except (KeyError, TypeError) as err:
            raise ValueError(f"malformed policy envelope: {err!r}") from None
        if not isinstance(query, str) or not query.strip():
            raise ValueError("policy envelope has no rewritten query")
        return cls(tables, query)

    def to_json(self) -> str:
        return json.dumps({"tables": [{"name": t} for t in self.tables], "rewrittenQuery": self.rewritten_query})


def base_query(component: str | Sequence[str]) -> str:
    """The query sent to the policy service for one component (O7), or for several.

    The same text serves both user queries: neither the patient nor the age
    range is sent. The component keeps its dots here; a rewritten query
    returns it under its stored name (dots as ``_``). The forms for all
    components ask for several at once; a repeated name is asked for once.
    """
    names = [component] if isinstance(component, str) else list(component)
    if not names:
        raise ValueError("no component given")
    columns = list(dict.fromkeys(policy_component_column(n) for n in names))
    return f"SELECT {', '.join([SUBJECT_ID, DATE, *columns])} FROM {BLOOD_TESTS}"


def policy_request(component: str | Sequence[str], purpose: str, requester_id: str = "") -> dict[str, str]:
    """The message asking the policy service to rewrite :func:`base_query`.

    ``purpose`` and ``requester_id`` come from the caller (the series query
    passes the requester, the average query leaves it empty). Sending it and
    waiting for the envelope is the caller's job.
    """
    values = (base_query(component), purpose, READ_ACCESS, "", "", requester_id)
    return dict(zip(REQUEST_FIELDS, values))


def policy_session(spark: SparkSession, catalog: Mapping[str, TableSpec], tables) -> SparkSession:
    """A child session sharing ``spark``'s context, with only ``tables`` as views.

    Runtime settings of the parent do not reach a new session on their own,
    so every modifiable one is copied (time zone, ANSI mode, case
    sensitivity, shuffle partitions, AQE, ...).
    """
    child = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if child.conf.get(key, None) != value and spark.conf.isModifiable(key):
            child.conf.set(key, value)
    register_tables(child, catalog, tables)
    return child


def run_policy(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope) -> DataFrame:
    """Rows the policy lets through: the rewritten query, minus rows with
    nothing visible but the subject id (O5, O6, O8)."""
    env = Envelope.parse(envelope)
    child = policy_session(spark, catalog, env.tables)
    check_query(child, env.rewritten_query, [view_name(t) for t in env.tables])
    return drop_all_null(check_analysed(child.sql(env.rewritten_query)), SUBJECT_ID)
