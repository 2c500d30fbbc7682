"""What a rewritten query may read and call: the envelope's tables and harmless built-in functions.

The session catalog lets any query reach metastore tables, global views,
files by path and commands, and some built-in functions reach Java methods,
files or the session. The query is therefore parsed first (by Spark's own
parser, nothing runs) and refused unless it is one query made of relational
steps over listed views, common table expressions or inline values, whose
functions are built-in and not on :data:`REFUSED_FUNCTIONS`. Once analysed
it is looked at again for what a name without parentheses can stand for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

# Leaf nodes that read nothing, and table functions over their own arguments.
_VALUES = ("OneRowRelation", "OneRowRelation$", "UnresolvedInlineTable", "LocalRelation")
_TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack")
# Steps a query may be made of; a script, a time travel or anything new is none of them.
_STEPS = ("Project", "Filter", "Aggregate", "Join", "LateralJoin", "AsOfJoin", "UnresolvedHaving", "Sort", "Distinct",
          "GlobalLimit", "LocalLimit", "Offset", "Union", "Except", "Intersect", "SubqueryAlias", "UnresolvedWith",
          "UnresolvedSubqueryColumnAliases", "UnresolvedHint", "WithWindowDefinition", "Generate", "Pivot", "Unpivot",
          "Sample", "RepartitionByExpression", "Repartition", "PipeOperator")
_STATEMENTS = ("org.apache.spark.sql.catalyst.plans.logical.Command",
               "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")

#: Built-in functions that reach Java methods, files named by an argument, or the session and its files.
REFUSED_FUNCTIONS = frozenset((
    "reflect", "java_method", "try_reflect",
    "from_avro", "to_avro", "schema_of_avro", "from_protobuf", "to_protobuf",
    "input_file_name", "input_file_block_start", "input_file_block_length",
    "current_user", "user", "session_user", "current_catalog", "current_database", "current_schema", "version"))
# The same, and functions that are not built in, as they are called in an analysed plan.
_REFUSED_CALLS = frozenset((
    "CallMethodViaReflection", "TryReflect", "AvroDataToCatalyst", "CatalystDataToAvro", "FromAvro", "ToAvro",
    "SchemaOfAvro", "FromProtobuf", "ToProtobuf", "ProtobufDataToCatalyst", "CatalystDataToProtobuf", "InputFileName",
    "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "CurrentDatabase", "CurrentCatalog", "SparkVersion",
    "ScalaUDF", "ScalaAggregator", "PythonUDF", "PythonUDAF", "PythonUDTF", "HiveSimpleUDF", "HiveGenericUDF",
    "HiveGenericUDTF", "HiveUDAFFunction", "ApplyFunctionExpression", "V2Aggregator"))


class PolicyViolation(ValueError):
    """A rewritten query that is not one query over the envelope's tables."""


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _names(seq) -> list[str]:
    return [str(x) for x in _items(seq)]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


_builtin: frozenset[str] | None = None


def builtin_functions(session: SparkSession) -> frozenset[str]:
    """Names of Spark's own scalar, aggregate and generator functions."""
    global _builtin
    if _builtin is None:
        registry = session.sparkContext._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        _builtin = frozenset(str(f.funcName()).lower() for f in _items(registry.listFunction()))
    return _builtin


def _own_expressions(node) -> list:
    """A node's expressions, those of named windows too."""
    found = _items(node.expressions())
    if _kind(node) == "WithWindowDefinition":
        windows = node.windowDefinitions().valuesIterator()
        while windows.hasNext():
            found.append(windows.next())
    return found


def _each(expressions: list, visit: Callable[[object, str], None]) -> None:
    todo = list(expressions)
    while todo:
        expression = todo.pop()
        visit(expression, _kind(expression))
        todo += _items(expression.children())


def check_query(session: SparkSession, query: str, views: Iterable[str]) -> None:
    """Raise :class:`PolicyViolation` unless ``query`` is one query reading only ``views`` and calling only harmless built-ins."""
    jvm = session.sparkContext._jvm
    statements = [jvm.java.lang.Class.forName(name) for name in _STATEMENTS]
    known = builtin_functions(session) - REFUSED_FUNCTIONS
    plan = session._jsparkSession.sessionState().sqlParser().parsePlan(query)

    def function(expression, kind: str) -> None:
        if kind == "UnresolvedFunction":
            name = _names(expression.nameParts())
        elif kind == "UnresolvedGenerator":
            name = str(expression.name().unquotedString()).split(".")
        elif "UnresolvedIdentifier" in kind:
            raise PolicyViolation("the rewritten query makes up a name (IDENTIFIER)")
        else:
            return
        if len(name) != 1 or name[0].lower() not in known:
            raise PolicyViolation(f"the rewritten query calls the function {'.'.join(name)!r}")

    def visit(node, allowed: frozenset[str]) -> None:
        kind = _kind(node)
        if any(s.isInstance(node) for s in statements):
            raise PolicyViolation(f"the rewritten query is a command or statement ({kind})")
        if kind == "UnresolvedWith":
            for cte in _items(node.innerChildren()):
                name = cte.alias().lower()
                visit(cte, allowed | {name} if node.allowRecursion() else allowed)
                allowed = allowed | {name}
        _each(_own_expressions(node), function)
        children = _items(node.children())
        if kind == "UnresolvedRelation":
            parts = _names(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in allowed:
                raise PolicyViolation(f"the rewritten query reads {'.'.join(parts)!r}, which the envelope does not list")
        elif kind == "UnresolvedTableValuedFunction":
            name = _names(node.name())
            if len(name) != 1 or name[0].lower() not in _TABLE_FUNCTIONS:
                raise PolicyViolation(f"the rewritten query calls the table function {'.'.join(name)!r}")
        elif not children and kind not in _VALUES:
            raise PolicyViolation(f"the rewritten query reads something else than a table ({kind})")
        elif children and kind not in _STEPS:
            raise PolicyViolation(f"the rewritten query has a step that is not allowed ({kind})")
        for child in [*children, *_items(node.subqueries())]:
            visit(child, allowed)

    visit(plan, frozenset(v.lower() for v in views))


def check_analysed(answer: DataFrame) -> DataFrame:
    """``answer``, unless its own steps call what no rewritten query may (the tables' own definitions are not looked into)."""
    def call(expression, kind: str) -> None:
        if kind in _REFUSED_CALLS:
            raise PolicyViolation(f"the rewritten query calls {kind}")

    def visit(node) -> None:
        if _kind(node) == "View":
            return
        _each(_items(node.expressions()), call)
        for child in [*_items(node.children()), *_items(node.innerChildren()), *_items(node.subqueries())]:
            visit(child)

    visit(answer._jdf.queryExecution().analyzed())
    return answer
