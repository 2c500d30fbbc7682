"""Rows that the scans and shuffles of an executed DataFrame handled, from its own plan's metrics."""


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(node):
    kind = node.getClass().getSimpleName()
    yield kind, node
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(node.executedPlan())
    elif kind.endswith("QueryStageExec"):
        yield from _nodes(node.plan())
    for child in [*_items(node.children()), *_items(node.subqueries())]:
        yield from _nodes(child)


def nodes(df):
    """``(kind, node)`` of the plan ``df`` ran with (collect it first)."""
    return list(_nodes(df._jdf.queryExecution().executedPlan()))


def _sum(df, kinds, metric):
    seen, total = set(), 0
    for kind, node in nodes(df):
        if kind in kinds and node.id() not in seen:
            seen.add(node.id())
            total += node.metrics().apply(metric).value()
    return total


def rows_scanned(df):
    return _sum(df, ("FileSourceScanExec",), "numOutputRows")


def rows_shuffled(df):
    return _sum(df, ("ShuffleExchangeExec",), "shuffleRecordsWritten")
