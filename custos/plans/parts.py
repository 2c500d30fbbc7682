"""Policy answers over split blood tests (:func:`custos.sources.layout.write_split`).

The cold part is bucketed and joins by bucket; the hot part holds few
patients, so the rows of other tables it can meet are few and measured. The
two are worked on apart and brought together at the end. That is right where
the rewritten query treats each blood test by itself and meets other tables
on the subject id only: plain projections and filters over ``blood_tests``
and inner or left joins from it on equal subject ids. Any other query
(aggregates, windows, subqueries, self-joins) runs over both parts as one
table, as an unsplit table would.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from custos.constants import BLOOD_TESTS, PROFILES, SUBJECT_ID
from custos.operators.join import broadcast_if_small
from custos.plans.policy import Envelope, run_policy
from custos.sources.catalog import HOT_KEYS, HOT_ROWS, SPLIT, TableSpec, load_table, view_name

_ROW_STEPS = ("Project", "Filter", "SubqueryAlias", "View", "Join")


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _same_subject(condition) -> bool:
    """Whether a join condition has ``a.patientId = b.patientId`` among its conjuncts."""
    todo = [condition]
    while todo:
        e = todo.pop()
        if _kind(e) == "And":
            todo += _items(e.children())
        elif _kind(e) == "EqualTo" and all(
                _kind(c) == "AttributeReference" and c.name() == SUBJECT_ID for c in _items(e.children())):
            return True
    return False


def _views(node) -> list[str]:
    if _kind(node) == "View":
        return [str(node.desc().identifier().table()).lower()]
    return [v for c in _items(node.children()) for v in _views(c)]


def row_by_row(answer: DataFrame) -> bool:
    """Whether the analysed query treats each blood test by itself, other tables joined on the subject id."""
    def visit(node) -> bool:
        kind = _kind(node)
        if kind == "View":
            return True
        if kind not in _ROW_STEPS or node.subqueries().size():
            return False
        if any("Window" in _kind(e) or "Generator" in _kind(e) for x in _items(node.expressions()) for e in _all(x)):
            return False
        if kind == "Join":
            left, right = _views(node.left()), _views(node.right())
            how = node.joinType().toString()
            if BLOOD_TESTS in right or BLOOD_TESTS not in left or how not in ("Inner", "LeftOuter", "LeftSemi", "LeftAnti"):
                return False
            if node.condition().isEmpty() or not _same_subject(node.condition().get()):
                return False
        return all(visit(c) for c in _items(node.children()))

    plan = answer._jdf.queryExecution().analyzed()
    return _views(plan).count(BLOOD_TESTS) == 1 and visit(plan)


def _all(expression) -> list:
    out, todo = [], [expression]
    while todo:
        e = todo.pop()
        out.append(e)
        todo += _items(e.children())
    return out


def policy_parts(spark: SparkSession, catalog: Mapping[str, TableSpec], envelope) -> list[tuple[DataFrame, Mapping[str, TableSpec]]]:
    """``[(compliant rows, catalog to join them with)]``: one entry, or the cold and the hot part of split blood tests."""
    env = Envelope.parse(envelope)
    whole = run_policy(spark, catalog, env)
    spec = catalog.get(BLOOD_TESTS)
    if spec is None or spec.kind != SPLIT or BLOOD_TESTS not in env.tables or not row_by_row(whole):
        return [(whole, catalog)]
    cold = {**catalog, BLOOD_TESTS: TableSpec.table(spec.location)}
    hot = dict(catalog)
    for name in {*env.tables, PROFILES} - {BLOOD_TESTS}:
        if view_name(name) != BLOOD_TESTS:
            hot[name] = TableSpec.derived(lambda s, name=name: _of_hot_keys(s, catalog, name, spec.location + HOT_KEYS))
    hot[BLOOD_TESTS] = TableSpec.table(spec.location + HOT_ROWS)
    return [(run_policy(spark, cold, env), cold), (run_policy(spark, hot, env), hot)]


def _of_hot_keys(session: SparkSession, catalog: Mapping[str, TableSpec], name: str, keys: str) -> DataFrame:
    """A table's rows of the hot keys, sent to all tasks if their measured size allows; a table without the key whole."""
    table = load_table(session, catalog, name)
    if SUBJECT_ID not in table.columns:
        return table
    # at most 1 / hot_share keys
    rows = table.join(broadcast_if_small(session.table(keys)), SUBJECT_ID, "left_semi")
    return broadcast_if_small(rows)
