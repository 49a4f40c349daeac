"""A Datalog over facts: EDN-like text or clause objects, compiled to DataFrame joins.

    [:find ?c (count ?o) :where [?o order/customer ?c] [?o order/total ?t] [(> ?t 1000.0)]
     (not [?c customer/blocked _]) :order-by ?c :limit 10]

Answers are sets. Patterns match LIVE facts. Without `not`, aggregates, ordering and limits a query
is monotone: more facts only add answers, so stores can answer separately.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import reachable
from ..scratch import materialize
from ..types import QueryError, lane

PREDICATES = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
AGGREGATES = {"count": lambda c: F.count_distinct(c), "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "exists": lambda c: F.count(c) > 0}


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Pattern:
    e: object
    a: str
    v: object


@dataclass(frozen=True)
class Predicate:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Negation:
    clauses: tuple


@dataclass(frozen=True)
class Call:
    """A use of a rule."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    fn: str
    var: Var

    @property
    def label(self) -> str:
        return f"{self.fn}_{self.var.name}"


@dataclass(frozen=True)
class Query:
    find: tuple
    where: tuple
    order_by: tuple = ()
    limit: int | None = None


@dataclass(frozen=True)
class Rule:
    name: str
    head: tuple
    body: tuple


_TOKEN = re.compile(r'"((?:[^"\\]|\\.)*)"|([\[\]()])|([^\s\[\]()"]+)')


def _tokens(text: str) -> list:
    text = re.sub(r";[^\n]*", "", text)
    out = []
    for m in _TOKEN.finditer(text):
        out.append(("str", re.sub(r"\\(.)", r"\1", m[1])) if m[1] is not None else m[2] or m[3])
    return out


def _read(tokens: list, at: int) -> tuple[object, int]:
    t = tokens[at]
    if t in ("[", "("):
        items, at = [], at + 1
        close = "]" if t == "[" else ")"
        while True:
            if at >= len(tokens):
                raise QueryError("unclosed " + t)
            if tokens[at] == close:
                return (items if t == "[" else tuple(items)), at + 1
            item, at = _read(tokens, at)
            items.append(item)
    if t in ("]", ")"):
        raise QueryError("unexpected " + t)
    return _atom(t), at + 1


def _atom(t) -> object:
    if isinstance(t, tuple):
        return ("text", t[1])
    if t.startswith("?"):
        return Var(t[1:])
    if t.startswith("$"):
        return Param(t[1:])
    if t in ("true", "false"):
        return t == "true"
    if re.fullmatch(r"[+-]?\d+", t):
        return int(t)
    if re.fullmatch(r"[+-]?\d*\.\d+(e[+-]?\d+)?", t):
        return float(t)
    return t


def _clause(x) -> object:
    if isinstance(x, list):
        if len(x) == 1 and isinstance(x[0], tuple):
            return _clause(x[0])
        if len(x) == 3:
            return Pattern(x[0], str(x[1]).removeprefix(":"), x[2])
        if len(x) == 2:
            return Pattern(x[0], str(x[1]).removeprefix(":"), "_")
    if isinstance(x, tuple) and x:
        if x[0] == "not":
            return Negation(tuple(_clause(c) for c in x[1:]))
        if x[0] in PREDICATES and len(x) == 3:
            return Predicate(*x)
        if isinstance(x[0], str):
            return Call(x[0], tuple(x[1:]))
    raise QueryError(f"no clause: {x}")


def parse(text: str) -> Query:
    tokens = _tokens(text)
    form, end = _read(tokens, 0) if tokens else ([], 0)
    if end != len(tokens) or not isinstance(form, list):
        raise QueryError("a query is one vector")
    parts: dict[str, list] = {}
    section = None
    for x in form:
        if isinstance(x, str) and x.startswith(":") and x[1:] in ("find", "where", "order-by", "limit"):
            section = parts.setdefault(x[1:], [])
        elif section is None:
            raise QueryError("a query starts with :find")
        else:
            section.append(x)
    if not parts.get("find") or "where" not in parts:
        raise QueryError("a query needs :find and :where")
    find = tuple(Aggregate(x[0], x[1]) if isinstance(x, tuple) else x for x in parts["find"])
    for f in find:
        if isinstance(f, Aggregate) and f.fn not in AGGREGATES or not isinstance(f, (Aggregate, Var)):
            raise QueryError(f"can't find {f}")
    order = tuple((x[1], True) if isinstance(x, tuple) and x[0] == "desc" else (x, False) for x in parts.get("order-by", []))
    return Query(find, tuple(_clause(c) for c in parts["where"]), order, parts["limit"][0] if parts.get("limit") else None)


def parse_rule(text: str) -> Rule:
    """[(name ?x ?y) clause ...]"""
    form, _ = _read(_tokens(text), 0)
    return Rule(form[0][0], tuple(form[0][1:]), tuple(_clause(c) for c in form[1:]))


def is_monotone(query: Query, rules: Sequence[Rule] = ()) -> bool:
    """Told from the syntax alone."""
    bodies = [query.where, *[r.body for r in rules]]
    return not (any(isinstance(c, Negation) for b in bodies for c in b) or any(isinstance(f, Aggregate) for f in query.find) or query.order_by or query.limit is not None)


def bound_entities(query: Query) -> list[bytes]:
    """Entities given as constants, whose shards alone can answer their patterns."""
    return [c.e for c in query.where if isinstance(c, Pattern) and isinstance(c.e, bytes)]


@dataclass
class Compiler:
    """Compiles clauses over LIVE facts; values of a variable share one column of their lane."""

    live: DataFrame
    params: dict = field(default_factory=dict)
    types: dict[str, int] = field(default_factory=dict)
    rules: dict[str, DataFrame] = field(default_factory=dict)
    #: Steps (src, dst) of rules that are closures, which are followed from the starts that a body binds.
    steps: dict[str, DataFrame] = field(default_factory=dict)
    #: The last body's rows if they are distinct as they are.
    known: DataFrame | None = None

    def _given(self, x):
        if isinstance(x, Param):
            if x.name not in self.params:
                raise QueryError(f"no value for ${x.name}")
            return self.params[x.name]
        return x[1] if isinstance(x, tuple) and x[:1] == ("text",) else x

    def _value_column(self, attribute: str) -> Column:
        tag = self.types.get(attribute)
        if tag is None:
            raise QueryError(f"the type of {attribute} isn't known")
        return F.col(lane(tag))

    def pattern(self, p: Pattern) -> DataFrame:
        rows, out = self.live.where(F.col("a") == p.a), {}
        for x, column in ((self._given(p.e), F.col("e")), (self._given(p.v), self._value_column(p.a))):
            if isinstance(x, Var):
                if x.name in out:
                    rows = rows.where(out[x.name] == column)
                out[x.name] = column
            elif x != "_":
                rows = rows.where(column == F.lit(x))
        return rows.select(*[c.alias(n) for n, c in out.items()]) if out else rows.select(F.lit(1).alias("_any")).limit(1)

    def _follows(self, c, have: DataFrame | None) -> bool:
        """Whether a clause is a closure whose starts are bound."""
        return have is not None and isinstance(c, Call) and c.name in self.steps and len(c.args) == 2 and isinstance(c.args[0], Var) and c.args[0].name in have.columns

    def call(self, c: Call, have: DataFrame | None = None) -> DataFrame:
        if self._follows(c, have):
            rows = reachable(self.steps[c.name], have.select(F.col(c.args[0].name).alias("id"))).toDF("_0", "_1")
        else:
            if c.name in self.steps and c.name not in self.rules:
                self.rules[c.name] = materialize(reachable(self.steps[c.name]).toDF("_0", "_1"), "datalog-rule")
            if c.name not in self.rules:
                raise QueryError(f"no rule {c.name}")
            rows = self.rules[c.name]
        out = {}
        for i, x in enumerate(c.args):
            x, column = self._given(x), F.col(f"_{i}")
            if isinstance(x, Var):
                if x.name in out:
                    rows = rows.where(out[x.name] == column)
                out[x.name] = column
            elif x != "_":
                rows = rows.where(column == F.lit(x))
        return rows.select(*[k.alias(n) for n, k in out.items()])

    def _operand(self, x, have: DataFrame) -> Column:
        x = self._given(x)
        if isinstance(x, Var):
            if x.name not in have.columns:
                raise QueryError(f"?{x.name} isn't bound")
            return F.col(x.name)
        return F.lit(x)

    def body(self, clauses: Sequence, start: DataFrame | None = None, keep: set[str] | None = None) -> DataFrame:
        """Relations with most constants first, always joined on shared variables; predicates as
        soon as bound; negations last. With `keep` the result is a set of these variables: where only a
        closure's starts are still wanted of what is bound, the closure takes its place without a join."""
        relations = sorted([c for c in clauses if isinstance(c, (Pattern, Call))], key=self._cost)
        predicates, negations = [c for c in clauses if isinstance(c, Predicate)], [c for c in clauses if isinstance(c, Negation)]
        have = start
        if have is None and not relations:
            raise QueryError("nothing binds the variables")
        while relations:
            shared = [c for c in relations if have is None or self._vars(c) & set(have.columns)]
            c = (shared or relations)[0]
            relations.remove(c)
            rows = self.pattern(c) if isinstance(c, Pattern) else self.call(c, have)
            later = set().union(keep or (), *[self._vars(x) for x in (*relations, *predicates, *negations)])
            if have is None:
                have = rows
            elif keep is not None and self._follows(c, have) and set(have.columns) & (later | self._vars(c)) == {c.args[0].name}:
                have, self.known = rows, rows
            else:
                on = [v for v in rows.columns if v in have.columns]
                if on:
                    have = have.join(rows, on)
                else:
                    raise QueryError("the clauses fall into parts that share no variable")
            ready = [p for p in predicates if self._vars(p) <= set(have.columns)]
            predicates = [p for p in predicates if p not in ready]
            for p in ready:
                have = have.where(getattr(self._operand(p.left, have), PREDICATES[p.op])(self._operand(p.right, have)))
        if predicates:
            raise QueryError("a predicate's variable isn't bound")
        for n in negations:
            inner = self.body(n.clauses)
            on = [v for v in inner.columns if v in have.columns]
            if not on:
                raise QueryError("a negation shares no variable")
            have = have.join(inner.select(*on).distinct(), on, "left_anti")
        return have

    def _vars(self, c) -> set[str]:
        if isinstance(c, Negation):
            return set().union(*[self._vars(x) for x in c.clauses])
        items = (c.e, c.v) if isinstance(c, Pattern) else c.args if isinstance(c, Call) else (c.left, c.right)
        return {x.name for x in items if isinstance(x, Var)}

    def _cost(self, c) -> int:
        return -sum(not isinstance(self._given(x), Var) and x != "_" for x in ((c.e, c.v) if isinstance(c, Pattern) else c.args))

    def run(self, q: Query) -> DataFrame:
        names = [f.name if isinstance(f, Var) else f.var.name for f in q.find]
        have = self.body(q.where, keep=None if any(isinstance(f, Aggregate) for f in q.find) else set(names))
        for n in names:
            if n not in have.columns:
                raise QueryError(f"?{n} isn't bound")
        aggs = [f for f in q.find if isinstance(f, Aggregate)]
        keys = [f.name for f in q.find if isinstance(f, Var)]
        if aggs:
            out = have.distinct().groupBy(*keys).agg(*[AGGREGATES[f.fn](f.var.name).alias(f.label) for f in aggs])
            out = out.select(*[f.name if isinstance(f, Var) else f.label for f in q.find])
        else:
            out = have.select(*keys)
            if have is not self.known or set(keys) != set(have.columns):
                out = out.distinct()
        if q.order_by:
            label = {f.var.name: f.label for f in aggs}
            out = out.orderBy(*[F.col(label.get(v.name, v.name)).desc() if down else F.col(label.get(v.name, v.name)).asc() for v, down in q.order_by])
        return out if q.limit is None else out.limit(q.limit)


def types_of(schema: DataFrame) -> dict[str, int]:
    """Attribute types from a schema; a row an attribute."""
    return {r["attr"]: r["value_type"] for r in schema.select("attr", "value_type").collect()}


def closures(rules: Sequence[Rule]) -> set[str]:
    """Names of rules that only chain steps: (r ?x ?z) from (r ?x ?y) and (r ?y ?z), and bodies without these rules."""
    names = {r.name for r in rules}

    def chains(r: Rule) -> bool:
        if len(r.head) != 2 or len(r.body) != 2 or not all(isinstance(c, Call) and c.name == r.name and len(c.args) == 2 and all(isinstance(x, Var) for x in c.args) for c in r.body):
            return False
        return any(a.args[0] == r.head[0] and b.args[1] == r.head[1] and a.args[1] == b.args[0] and len({*r.head, a.args[1]}) == 3 for a, b in (r.body, r.body[::-1]))

    out = set()
    for n in names:
        own = [r for r in rules if r.name == n]
        first = [r for r in own if not chains(r)]
        if first and len(first) < len(own) and all(len(r.head) == 2 and not any(isinstance(c, Call) and c.name in names for c in r.body) for r in first):
            out.add(n)
    return out


def solve_rules(compiler: Compiler, rules: Sequence[Rule]) -> None:
    """Fixpoint of positive rules, semi-naive: each round joins last round's new rows only. Rules that
    only chain steps are left to `reachable`, which is given the starts that the query binds.

    Rounds are written to the shared folder so plans stay small.
    """
    names = list(dict.fromkeys(r.name for r in rules))
    for r in rules:
        if any(isinstance(c, Negation) for c in r.body):
            raise QueryError("rules hold no negation")

    def rows(r: Rule, c: Compiler) -> DataFrame:
        have = c.body(r.body)
        return have.select(*[F.col(v.name).alias(f"_{i}") for i, v in enumerate(r.head)])

    for n in closures(rules):
        steps = None
        for r in rules:
            if r.name == n and not any(isinstance(c, Call) and c.name == n for c in r.body):
                found = rows(r, compiler).toDF("src", "dst")
                steps = found if steps is None else steps.unionByName(found)
        if dict(steps.dtypes)["src"] == dict(steps.dtypes)["dst"]:
            compiler.steps[n] = steps
            rules = [r for r in rules if r.name != n]
            names.remove(n)
    total: dict[str, DataFrame] = {}
    for r in rules:
        if not any(isinstance(c, Call) and c.name in names for c in r.body):
            found = rows(r, compiler)
            total[r.name] = found if r.name not in total else total[r.name].unionByName(found)
    total = {n: materialize(t.distinct(), "datalog-rule") for n, t in total.items()}
    fresh = dict(total)
    while fresh:
        new: dict[str, DataFrame] = {}
        for r in rules:
            for at, clause in enumerate(r.body):
                if isinstance(clause, Call) and clause.name in names and clause.name in fresh:
                    # this use sees the new rows, the others everything
                    body = tuple(Call("_fresh", clause.args) if i == at else c for i, c in enumerate(r.body))
                    c = Compiler(compiler.live, compiler.params, compiler.types, {**compiler.rules, **total, "_fresh": fresh[clause.name]}, compiler.steps)
                    found = rows(Rule(r.name, r.head, body), c)
                    new[r.name] = found if r.name not in new else new[r.name].unionByName(found)
        fresh = {}
        for n, t in new.items():
            t = t.distinct()
            if n in total:
                t = t.join(total[n], t.columns, "left_anti")
            t = materialize(t, "datalog-rule")
            if not t.isEmpty():
                fresh[n] = t
                total[n] = t if n not in total else total[n].unionByName(t)
    compiler.rules.update(total)


def query(live: DataFrame, q: Query | str, types: dict[str, int], params: dict | None = None, rules: Sequence[Rule | str] = ()) -> DataFrame:
    """Answers of a query over LIVE facts; columns are the variables' names."""
    q = parse(q) if isinstance(q, str) else q
    if rules:  # every round reads the facts again
        used = {c.a for r in [parse_rule(r) if isinstance(r, str) else r for r in rules] for c in (*r.body, *q.where) if isinstance(c, Pattern)}
        live = materialize(live.where(F.col("a").isin(*used)), "datalog-live")
    compiler = Compiler(live, params or {}, types)
    if rules:
        solve_rules(compiler, [parse_rule(r) if isinstance(r, str) else r for r in rules])
    return compiler.run(q)
