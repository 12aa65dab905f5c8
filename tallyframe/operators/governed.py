"""Governed questions: a typed tree over the allowed relations, checked node by node, run as DataFrame calls.

A ``Question`` names what to select from a relation, its joins along declared paths, filters, groups, order and
limit. Nothing in it is text to be interpreted: whatever has no node cannot be asked. Checks come first, so a refused
question has touched no data; a refusal names the part of the question, never a value.

Totals over joins are combined before the join where that gives the same rows: facts are grouped by the
join's keys, so a key with a large share of the facts crosses the shuffle as one partial row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.contract import RELATIONSHIPS
from tallyframe.operators.access import ALLOWED_FUNCTIONS, AccessDenied, bounded, call

Value = str | int | float | bool | Decimal | date | datetime | None


@dataclass(frozen=True)
class Col:
    """``alias.column``, or ``column`` where only one relation has it."""

    name: str


@dataclass(frozen=True)
class Lit:
    value: Value


@dataclass(frozen=True)
class Call:
    """An allowed function; COUNT without arguments counts rows; only COUNT takes ``distinct``."""

    function: str
    args: tuple[Expr, ...] = ()
    distinct: bool = False


@dataclass(frozen=True)
class Cast:
    value: Expr
    kind: str


@dataclass(frozen=True)
class Extract:
    part: str
    value: Expr


@dataclass(frozen=True)
class Trunc:
    unit: str
    value: Expr


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr = Lit(None)


@dataclass(frozen=True)
class Compare:
    left: Expr
    op: str
    right: Expr


@dataclass(frozen=True)
class In:
    value: Expr
    options: tuple[Value, ...]


@dataclass(frozen=True)
class IsNull:
    value: Expr
    negated: bool = False


@dataclass(frozen=True)
class All:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Any:
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not:
    part: Expr


@dataclass(frozen=True)
class Arith:
    left: Expr
    op: str
    right: Expr


Expr = Col | Lit | Call | Cast | Extract | Trunc | Case | Compare | In | IsNull | All | Any | Not | Arith


@dataclass(frozen=True)
class Join:
    """A declared path from ``start`` (an alias) to the relation at its other end."""

    path: str
    alias: str
    start: str
    how: str = "left"


@dataclass(frozen=True)
class Having:
    """Rows of ``start`` that have at least one row behind a declared path, seen from its far end (EXISTS)."""

    path: str
    alias: str
    start: str
    where: Expr | None = None


@dataclass(frozen=True)
class Question:
    """``relation`` is a name such as ``main.cards``, or another question whose columns are its selected names."""

    relation: str | Question
    alias: str
    select: tuple[tuple[str, Expr], ...]
    joins: tuple[Join, ...] = ()
    exists: tuple[Having, ...] = ()
    where: Expr | None = None
    #: what is grouped by beside the selected expressions without aggregates
    group: tuple[Expr, ...] = ()
    having: Expr | None = None
    #: selected names and whether they descend; nulls come last
    order: tuple[tuple[str, bool], ...] = ()
    limit: int | None = None


AGGREGATES = ("SUM", "COUNT", "AVG", "MIN", "MAX")
_COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_ARITHMETIC: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0))}
_PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
_KINDS = ("bigint", "integer", "double", "string", "date", "timestamp", "boolean", "decimal(38,2)", "decimal(18,2)")
_HOW = ("left", "inner")
_DEEPEST = 64


def _children(node: Expr) -> tuple[Expr, ...]:
    match node:
        case Col() | Lit():
            return ()
        case Call(args=args):
            return args
        case Cast(value=value) | Extract(value=value) | Trunc(value=value) | In(value=value) | IsNull(value=value):
            return (value,)
        case Case(whens=whens, otherwise=otherwise):
            return (*[x for when in whens for x in when], otherwise)
        case Compare(left=left, right=right) | Arith(left=left, right=right):
            return left, right
        case All(parts=parts) | Any(parts=parts):
            return parts
        case Not(part=part):
            return (part,)
        case _:
            raise AccessDenied("A part of the question is of no known kind")


def walk(node: Expr, depth: int = 0) -> Iterator[Expr]:
    if depth > _DEEPEST:
        raise AccessDenied("The question is nested too deeply")
    yield node
    for child in _children(node):
        yield from walk(child, depth + 1)


def _aggregated(node: Expr) -> bool:
    return any(isinstance(n, Call) and n.function.upper() in AGGREGATES for n in walk(node))


def relations_used(question: Question) -> tuple[str, ...]:
    """The relations that a question reads, each once, those of inner questions included."""
    found = list(relations_used(question.relation)) if isinstance(question.relation, Question) else [question.relation.lower()]
    for step in (*question.joins, *question.exists):
        path = _path(step.path)
        found.append(f"main.{path.right if isinstance(step, Join) else path.left}")
    return tuple(dict.fromkeys(found))


def _path(name: str):
    if name not in RELATIONSHIPS:
        raise AccessDenied("No such join path for you")
    return RELATIONSHIPS[name]


@dataclass
class _Scope:
    """Aliases with the relation they stand for (None for an inner question) and its columns."""

    relations: dict[str, str | None] = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)

    def add(self, alias: str, relation: str | None, columns: list[str]) -> None:
        if not alias.isidentifier() or alias in self.relations:
            raise AccessDenied("Aliases are to be distinct words")
        self.relations[alias], self.columns[alias] = relation, columns

    def find(self, name: str) -> tuple[str, str]:
        """(alias, column) of a column's name."""
        if "*" in name:
            raise AccessDenied("Columns are to be named one by one")
        alias, _, bare = name.rpartition(".")
        if alias:
            if bare not in self.columns.get(alias, ()):
                raise AccessDenied("No such column for you")
            return alias, bare
        owners = [(a, c) for a, columns in self.columns.items() for c in columns if c.lower() == bare.lower()]
        if len(owners) != 1:
            raise AccessDenied("Say whose column is meant" if owners else "No such column for you")
        return owners[0]


class Governed:
    """Answers questions over the relations it is given."""

    def __init__(self, relations: dict[str, DataFrame]):
        self._relations = {f"main.{name}".lower(): df for name, df in relations.items()}

    # ---- checks

    def _relation(self, name: str) -> DataFrame:
        if "." not in name:
            raise AccessDenied("Name relations as main.relation")
        if name.lower() not in self._relations:
            raise AccessDenied("No such relation for you")
        return self._relations[name.lower()]

    def _scope(self, question: Question) -> _Scope:
        scope = _Scope()
        if isinstance(question.relation, Question):
            scope.add(question.alias, None, [n for n, _ in question.relation.select])
        else:
            scope.add(question.alias, question.relation.lower().partition(".")[2], self._relation(question.relation).columns)
        for join in question.joins:
            path = _path(join.path)
            if scope.relations.get(join.start) != path.left:
                raise AccessDenied("This path does not start there")
            if join.how not in _HOW:
                raise AccessDenied("Paths are followed by a left or an inner join")
            scope.add(join.alias, path.right, self._relation(f"main.{path.right}").columns)
        for step in question.exists:
            path = _path(step.path)
            if scope.relations.get(step.start) != path.right:
                raise AccessDenied("This path does not end there")
            self._relation(f"main.{path.left}")
        return scope

    def _check(self, node: Expr, scope: _Scope, aggregates: bool) -> None:
        """Every node is of a known kind, in scope, and aggregates stand where they may and not in one another."""
        for part in walk(node):
            match part:
                case Col(name=name):
                    scope.find(name)
                case Lit(value=value):
                    if not isinstance(value, Value):
                        raise AccessDenied("A value is of no known kind")
                case Call(function=function, args=args, distinct=distinct):
                    name = function.upper()
                    if name in ("CASE", "CAST", "EXTRACT", "TIMESTAMP_TRUNC", "COUNT_DISTINCT"):
                        raise AccessDenied(f"{name} has a node of its own")
                    if name not in ALLOWED_FUNCTIONS:
                        raise AccessDenied("No such function for you")
                    if name not in AGGREGATES:
                        pass
                    elif not aggregates or any(map(_aggregated, args)):
                        raise AccessDenied("An aggregate may not stand here")
                    elif len(args) != 1 and not (name == "COUNT" and not args and not distinct):
                        raise AccessDenied("An aggregate takes one argument")
                    if distinct and name != "COUNT":
                        raise AccessDenied("Only counts are of distinct values")
                case Cast(kind=kind):
                    if kind not in _KINDS:
                        raise AccessDenied("No such type for you")
                case Extract(part=unit) | Trunc(unit=unit):
                    if unit.lower() not in _PARTS:
                        raise AccessDenied("No such part of a time")
                case Compare(op=op):
                    if op not in _COMPARISONS:
                        raise AccessDenied("No such comparison for you")
                case Arith(op=op):
                    if op not in _ARITHMETIC:
                        raise AccessDenied("No such operation for you")
                case In(options=options):
                    if not options or not all(isinstance(o, Value) for o in options):
                        raise AccessDenied("Options are to be values")

    def check(self, question: Question, inner: bool = False) -> None:
        """Refuse a question that is outside the allowlists; nothing is read."""
        if isinstance(question.relation, Question):
            self.check(question.relation, True)
        scope = self._scope(question)
        names = [n for n, _ in question.select]
        if not names or len({n.lower() for n in names}) < len(names) or not all(n.isidentifier() for n in names):
            raise AccessDenied("Selected names are to be distinct words")
        for _, node in question.select:
            self._check(node, scope, True)
        for node in (*question.group, *([question.where] if question.where else [])):
            self._check(node, scope, False)
        if question.having:
            if not self._grouped(question):
                raise AccessDenied("Only groups are filtered by their totals")
            self._check(question.having, scope, True)
        for step in question.exists:
            if step.where:
                far = _Scope()
                far.add(step.alias, None, self._relation(f"main.{_path(step.path).left}").columns)
                self._check(step.where, far, False)
        if any(name not in names for name, _ in question.order):
            raise AccessDenied("Results are ordered by what is selected")
        if question.limit is not None and (isinstance(question.limit, bool) or not isinstance(question.limit, int) or not 1 <= question.limit <= 100):
            raise AccessDenied("Ask for 1 to 100 rows")

    @staticmethod
    def _grouped(question: Question) -> bool:
        return bool(question.group) or any(_aggregated(node) for _, node in question.select)

    # ---- compiling

    def answer(self, question: Question) -> DataFrame:
        """Check, then build the result; without a limit it has 100 rows at most, unless it is one row of totals."""
        self.check(question)
        try:
            rows = self._build(question)
        except AnalysisException as error:
            raise AccessDenied("The types of the question do not fit") from error
        scalar = self._grouped(question) and all(_aggregated(node) for _, node in question.select) and not question.group
        return bounded(rows, question.limit, scalar=scalar)

    def _build(self, question: Question) -> DataFrame:
        scope = self._scope(question)
        base = self._build(question.relation) if isinstance(question.relation, Question) else self._relation(question.relation)
        rows = self._marked(base, question.alias, scope)
        local = [question.alias]
        early, late = [], []
        for part in question.where.parts if isinstance(question.where, All) else [question.where] if question.where else []:
            (early if self._only(part, scope, local) else late).append(part)
        # conditions on the base come before anything else; Catalyst moves the others below the joins where it may
        for part in early:
            rows = rows.where(self._column(part, scope))
        for step in question.exists:
            if step.start == question.alias:
                rows = self._semi(rows, step)
        if self._combines(question, scope, late):
            return self._finished(self._combined(rows, question, scope), question)
        rows = self._joined(rows, question, scope)
        for step in question.exists:
            if step.start != question.alias:
                rows = self._semi(rows, step)
        for part in late:
            rows = rows.where(self._column(part, scope))
        if not self._grouped(question):
            # order by what is selected, then keep that
            return self._finished(rows.select(*[self._column(n, scope).alias(name) for name, n in question.select]), question)
        keys = [n for _, n in question.select if not _aggregated(n)]
        groups = {n: f"_g{i}" for i, n in enumerate(dict.fromkeys([*keys, *question.group]))}
        totals = [(name, n) for name, n in question.select if _aggregated(n)] + ([("_having", question.having)] if question.having else [])
        values = [self._column(n, scope).alias(name) for name, n in totals] or [F.count(F.lit(1)).alias("_rows")]
        grouped = rows.groupBy(*[self._column(n, scope).alias(g) for n, g in groups.items()]).agg(*values) if groups else rows.agg(*values)
        return self._finished(self._named(grouped, question, groups), question)

    @staticmethod
    def _named(grouped: DataFrame, question: Question, groups: dict[Expr, str]) -> DataFrame:
        if question.having:
            grouped = grouped.where("_having")
        return grouped.select(*[(F.col(name) if _aggregated(n) else F.col(groups[n])).alias(name) for name, n in question.select])

    @staticmethod
    def _finished(rows: DataFrame, question: Question) -> DataFrame:
        by = [F.desc_nulls_last(name) if descending else F.asc_nulls_last(name) for name, descending in question.order]
        rows = rows.orderBy(*by) if by else rows
        return rows if question.limit is None else rows.limit(question.limit)

    @staticmethod
    def _marked(df: DataFrame, alias: str, scope: _Scope) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{alias}__{c}") for c in scope.columns[alias]])

    def _joined(self, rows: DataFrame, question: Question, scope: _Scope) -> DataFrame:
        for join in question.joins:
            path = _path(join.path)
            other = self._marked(self._relation(f"main.{path.right}"), join.alias, scope)
            on = None
            for key in path.keys:
                same = F.col(f"{join.start}__{key}") == F.col(f"{join.alias}__{key}")
                on = same if on is None else on & same
            rows = rows.join(other, on, join.how)
        return rows

    def _semi(self, rows: DataFrame, step: Having) -> DataFrame:
        """Activity is reduced to its keys before the join."""
        path = _path(step.path)
        source, far = self._relation(f"main.{path.left}"), _Scope()
        far.add(step.alias, path.left, source.columns)
        other = self._marked(source, step.alias, far)
        if step.where:
            other = other.where(self._column(step.where, far))
        keys = other.select(*[F.col(f"{step.alias}__{k}").alias(f"_k_{k}") for k in path.keys]).distinct()
        on = None
        for k in path.keys:
            same = F.col(f"{step.start}__{k}") == F.col(f"_k_{k}")
            on = same if on is None else on & same
        return rows.join(keys, on, "left_semi")

    @staticmethod
    def _only(node: Expr, scope: _Scope, aliases: list[str]) -> bool:
        return all(scope.find(n.name)[0] in aliases for n in walk(node) if isinstance(n, Col))

    def _combines(self, question: Question, scope: _Scope, late: list[Expr]) -> bool:
        """Whether totals may be combined before the joins: they, and the filters, read the base only, and every path starts there."""
        if not question.joins or late or not any(_aggregated(n) for _, n in question.select):
            return False
        base, others = [question.alias], [j.alias for j in question.joins]
        if any(j.start != question.alias for j in question.joins) or any(s.start != question.alias for s in question.exists):
            return False
        nodes = [n for _, n in question.select] + list(question.group) + ([question.having] if question.having else [])
        for node in nodes:
            if not _aggregated(node):
                if not (self._only(node, scope, base) or self._only(node, scope, others)):
                    return False
                continue
            for n in walk(node):
                if isinstance(n, Call) and n.function.upper() in AGGREGATES and (n.distinct or not all(self._only(a, scope, base) for a in n.args)):
                    return False
            # outside its aggregates a total reads nothing
            if any(isinstance(n, Col) for n in self._outside(node)):
                return False
        return True

    def _outside(self, node: Expr) -> Iterator[Expr]:
        if isinstance(node, Call) and node.function.upper() in AGGREGATES:
            return
        yield node
        for child in _children(node):
            yield from self._outside(child)

    def _combined(self, rows: DataFrame, question: Question, scope: _Scope) -> DataFrame:
        base = [question.alias]
        keys = dict.fromkeys(f"{question.alias}__{k}" for j in question.joins for k in _path(j.path).keys)
        nodes = [n for _, n in question.select] + list(question.group)
        mine = {n: f"_b{i}" for i, n in enumerate(dict.fromkeys(n for n in nodes if not _aggregated(n) and self._only(n, scope, base)))}
        totals = [n for n in nodes if _aggregated(n)] + ([question.having] if question.having else [])
        wanted = dict.fromkeys(n for t in totals for n in walk(t) if isinstance(n, Call) and n.function.upper() in AGGREGATES)
        partial, merged = [], {}
        for i, node in enumerate(wanted):
            name, value = node.function.upper(), self._column(node.args[0], scope) if node.args else F.lit(1)
            if name in ("SUM", "MIN", "MAX"):
                partial.append(call(name, value).alias(f"_p{i}"))
                merged[node] = call(name, F.col(f"_p{i}"))
            elif name == "COUNT":
                partial.append(F.count(value).alias(f"_p{i}"))
                merged[node] = F.coalesce(F.sum(f"_p{i}"), F.lit(0)).cast("long")
            else:
                partial += [F.sum(value).alias(f"_p{i}"), F.count(value).alias(f"_c{i}")]
                merged[node] = F.sum(f"_p{i}").cast("double") / F.nullif(F.sum(f"_c{i}"), F.lit(0))
        combined = rows.groupBy(*keys, *[self._column(n, scope).alias(name) for n, name in mine.items()]).agg(*partial)
        joined = self._joined(combined, question, scope)
        groups = {n: f"_g{i}" for i, n in enumerate(dict.fromkeys(n for n in nodes if not _aggregated(n)))}
        by = [(F.col(mine[n]) if n in mine else self._column(n, scope)).alias(g) for n, g in groups.items()]
        values = [self._column(n, scope, merged).alias(name) for name, n in question.select if _aggregated(n)]
        if question.having:
            values.append(self._column(question.having, scope, merged).alias("_having"))
        return self._named(joined.groupBy(*by).agg(*values) if by else joined.agg(*values), question, groups)

    def _column(self, node: Expr, scope: _Scope, merged: dict[Expr, Column] | None = None) -> Column:
        def build(n: Expr) -> Column:
            return self._column(n, scope, merged)

        if merged and node in merged:
            return merged[node]
        match node:
            case Col(name=name):
                return F.col("__".join(scope.find(name)))
            case Lit(value=value):
                return F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)
            case Call(function=function, args=args, distinct=distinct):
                if function.upper() == "COUNT":
                    return F.count_distinct(build(args[0])) if distinct else F.count(build(args[0]) if args else F.lit(1))
                if function.upper() == "ROUND" and len(args) == 2 and isinstance(args[1], Lit):
                    return call("ROUND", build(args[0]), args[1].value)
                return call(function, *map(build, args))
            case Cast(value=value, kind=kind):
                return build(value).cast("timestamp_ntz" if kind == "timestamp" else kind)
            case Extract(part=part, value=value):
                return call("EXTRACT", part, build(value))
            case Trunc(unit=unit, value=value):
                return call("TIMESTAMP_TRUNC", unit, build(value))
            case Case(whens=whens, otherwise=otherwise):
                column = F
                for condition, value in whens:
                    column = column.when(build(condition), build(value))
                return column.otherwise(build(otherwise))
            case Compare(left=left, op=op, right=right):
                return _COMPARISONS[op](build(left), build(right))
            case Arith(left=left, op=op, right=right):
                return _ARITHMETIC[op](build(left), build(right))
            case In(value=value, options=options):
                return build(value).isin(*options)
            case IsNull(value=value, negated=negated):
                return build(value).isNotNull() if negated else build(value).isNull()
            case All(parts=parts) | Any(parts=parts):
                columns = [build(p) for p in parts]
                out = columns[0] if columns else F.lit(isinstance(node, All))
                for other in columns[1:]:
                    out = out & other if isinstance(node, All) else out | other
                return out
            case Not(part=part):
                return ~build(part)
        raise AccessDenied("A part of the question is of no known kind")
