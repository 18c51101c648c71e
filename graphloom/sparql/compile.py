"""Algebra to lazy DataFrames: a relation is a DataFrame with a column and a kind for each variable."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..terms import TERM, Kind, as_term, exact, literal, native, number_term, rank
from ..virtual import CLASS, COL, TAB, VirtualGraphs
from . import parser as ast
from .expressions import Scope, ebv, evaluate, order_keys

_TYPE = ast.RDF + "type"


@dataclass
class Rel:
    """maybe: variables that can be unbound (NULL)."""

    df: DataFrame
    kinds: dict[str, Kind]
    maybe: frozenset = frozenset()

    def col(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def select(self, names) -> Rel:
        names = [n for n in names if n in self.kinds]
        return Rel(self.df.select(*map(self.col, names)), {n: self.kinds[n] for n in names}, self.maybe & set(names))

    def as_terms(self, names) -> Rel:
        out = [as_term(self.col(n), k).alias(n) if n in names else self.col(n) for n, k in self.kinds.items()]
        return Rel(self.df.select(*out), {n: TERM if n in names else k for n, k in self.kinds.items()}, self.maybe)


class Compiler:
    """source: VirtualGraphs, or an object with scan(s, p, o, graphs) -> DataFrame of g, s, p, o and urns."""

    def __init__(self, spark: SparkSession, source, default_union: bool = True, optimizer=None):
        self.spark, self.source, self.default_union, self.optimizer = spark, source, default_union, optimizer
        self.count, self.graphs = 0, []

    def fresh(self, tag: str = "x") -> str:
        self.count += 1
        return f".{tag}{self.count}"

    # Queries.
    def query(self, q: ast.Query) -> Rel:
        named = [i.value for i in q.named] if q.named or q.sources else self.source.urns
        default = [i.value for i in q.sources] if q.sources or q.named else (self.source.urns if self.default_union else [])
        self.named = [u for u in named if u in self.source.urns]
        rel = self.pattern(q.where, [u for u in default if u in self.source.urns])
        return self.modifiers(q, rel)

    def modifiers(self, q: ast.Query, rel: Rel) -> Rel:
        aggregates: dict[ast.Call, str] = {}

        def lift(e):
            if isinstance(e, ast.Call) and e.name in ast.AGGREGATES:
                return ast.Var(aggregates.setdefault(e, self.fresh("agg")))
            if isinstance(e, ast.Call):
                return ast.Call(e.name, tuple(lift(a) for a in e.args), e.distinct, e.sep)
            return e

        project = None if q.project is None else [(v, None if e is None else lift(e)) for v, e in q.project]
        having, order = [lift(e) for e in q.having], [(lift(e), down) for e, down in q.order]
        if aggregates or q.group:
            rel = self.aggregate(rel, q.group, aggregates)
        for e in having:
            rel = self.filter(e, rel)
        names = []
        for v, e in project or []:
            if e is not None:
                rel = self.extend(rel, v.name, e)
            names.append(v.name)
        if project is None:
            names = [n for n in rel.kinds if not n.startswith(".")]
        missing = [n for n in names if n not in rel.kinds]
        for n in missing:
            rel = Rel(rel.df.withColumn(n, F.lit(None).cast("string")), {**rel.kinds, n: TERM}, rel.maybe | {n})
        keys = [k for e, down in order for k in order_keys(*evaluate(e, self.scope(rel)), down)]
        if q.distinct:
            rel = rel.select(names)
            rel = Rel(rel.df.distinct(), rel.kinds, rel.maybe)
        df = rel.df.orderBy(*keys) if keys else rel.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        rel = Rel(df, rel.kinds, rel.maybe)
        return rel if q.form in ("CONSTRUCT", "DESCRIBE") else rel.select(names)

    def aggregate(self, rel: Rel, group, aggregates: dict[ast.Call, str]) -> Rel:
        for v, e in group:
            if not (isinstance(e, ast.Var) and e == v):
                rel = self.extend(rel, v.name, e)
        keys = [v.name for v, _ in group]
        visible = [n for n in rel.kinds if not n.startswith(".")]
        columns, kinds = [], {k: rel.kinds.get(k, TERM) for k in keys}
        after: dict[str, Column] = {}
        for call, name in aggregates.items():
            if call.args == ("*",):
                c = F.count_distinct(F.struct(*map(rel.col, visible))) if call.distinct else F.count(F.lit(1))
                columns.append(c.alias(name))
                kinds[name] = Kind("int")
                continue
            c, kind = evaluate(call.args[0], self.scope(rel))
            if call.name == "COUNT":
                columns.append((F.count_distinct(c) if call.distinct else F.count(c)).alias(name))
                kinds[name] = Kind("int")
            elif call.name in ("SUM", "AVG"):
                if kind.name not in ("int", "decimal", "double"):
                    columns.append(_term_total(call, c, kind).alias(name))
                    kinds[name] = TERM
                    continue
                number = kind.name if kind.name in ("int", "decimal", "double") else "double"
                c = native(c, kind, number)
                if call.name == "SUM":
                    f = F.sum_distinct(c) if call.distinct else F.sum(c)
                else:
                    f = F.avg(F.when(c.isNotNull(), c)) if not call.distinct else F.sum_distinct(c) / F.count_distinct(c)
                    number = "double" if number == "double" else "decimal"
                columns.append(F.coalesce(f.cast({"int": "bigint", "decimal": "decimal(38,18)", "double": "double"}[number]), F.lit(0)).cast({"int": "bigint", "decimal": "decimal(38,18)", "double": "double"}[number]).alias(name))
                kinds[name] = Kind(number)
            elif call.name in ("MIN", "MAX"):
                if kind.name == "term":
                    keys_ = F.struct(*(k for k in order_keys(c, kind, None)))
                    columns.append((F.min_by if call.name == "MIN" else F.max_by)(c, F.when(c.isNotNull(), keys_)).alias(name))
                else:
                    columns.append((F.min if call.name == "MIN" else F.max)(c).alias(name))
                kinds[name] = kind
            elif call.name == "SAMPLE":
                columns.append(F.min(c).alias(name))
                kinds[name] = kind
            else:
                from ..terms import lexical

                text = lexical(c, kind)
                items = F.sort_array((F.collect_set if call.distinct else F.collect_list)(text))
                columns.append(F.array_join(items, " " if call.sep is None else call.sep).alias(name))
                kinds[name] = Kind("str")
        grouped = rel.df.groupBy(*map(rel.col, keys)).agg(*columns) if columns else rel.df.select(*map(rel.col, keys)).distinct()
        del after
        return Rel(grouped, kinds, frozenset(kinds))

    def scope(self, rel: Rel) -> Scope:
        return Scope({n: (rel.col(n), k) for n, k in rel.kinds.items()})

    def extend(self, rel: Rel, name: str, e) -> Rel:
        rel, e = self.marked(rel, e)
        c, kind = evaluate(e, self.scope(rel))
        return Rel(rel.df.withColumn(name, c), {**rel.kinds, name: kind}, rel.maybe | {name})

    # Patterns.
    def pattern(self, node, graphs: list[str]) -> Rel:
        if isinstance(node, ast.Query):
            outer = self.named
            rel = self.modifiers(node, self.pattern(node.where, graphs))
            self.named = outer
            return rel
        if isinstance(node, ast.BGP):
            return self.bgp(node.triples, graphs)
        if isinstance(node, ast.Join):
            return self.join(self.pattern(node.left, graphs), self.pattern(node.right, graphs))
        if isinstance(node, ast.LeftJoin):
            return self.left_join(self.pattern(node.left, graphs), self.pattern(node.right, graphs), node.expr)
        if isinstance(node, ast.Union):
            return self.union([self.pattern(node.left, graphs), self.pattern(node.right, graphs)])
        if isinstance(node, ast.Minus):
            return self.minus(self.pattern(node.left, graphs), self.pattern(node.right, graphs))
        if isinstance(node, ast.Filter):
            rel = self.pattern(node.pattern, graphs)
            self.graphs = graphs  # those of EXISTS
            return self.filter(node.expr, rel, graphs)
        if isinstance(node, ast.Extend):
            rel = self.pattern(node.pattern, graphs)
            self.graphs = graphs
            return self.extend(rel, node.var.name, node.expr)
        if isinstance(node, ast.Values):
            return self.values(node)
        if isinstance(node, ast.Graph):
            if isinstance(node.term, ast.Iri):
                return self.pattern(node.pattern, [node.term.value] if node.term.value in self.named else [])
            parts = []
            for urn in self.named:
                r = self.pattern(node.pattern, [urn])
                g = Rel(self.spark.range(1).select(F.lit(urn).alias(node.term.name)), {node.term.name: TERM})
                parts.append(self.join(r, g) if node.term.name in r.kinds else Rel(r.df.withColumn(node.term.name, F.lit(urn)), {**r.kinds, node.term.name: TERM}, r.maybe))
            return self.union(parts) if parts else self.empty({node.term.name} | {v.name for v in ast.bound(node.pattern)})
        raise SparqlUnsupported(type(node).__name__)

    def empty(self, names) -> Rel:
        schema = ", ".join(f"`{n}` string" for n in names) or "`.none` string"
        return Rel(self.spark.createDataFrame([], schema), {n: TERM for n in names})

    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias(".unit")), {})

    def values(self, node: ast.Values) -> Rel:
        names = [v.name for v in node.vars]
        rows = [tuple(None if x is None else constant(x) for x in row) for row in node.rows]
        df = self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))
        return Rel(df, {n: TERM for n in names}, frozenset(n for i, n in enumerate(names) if any(r[i] is None for r in rows)))

    def aligned(self, a: Rel, b: Rel, shared) -> tuple[Rel, Rel]:
        """Shared variables in one kind: their own if it is the same, else canonical terms."""
        differ = {n for n in shared if a.kinds[n] != b.kinds[n]}
        return (a.as_terms(differ), b.as_terms(differ)) if differ else (a, b)

    def renamed(self, b: Rel, names) -> tuple[Rel, dict[str, str]]:
        new = {n: self.fresh("r") for n in names}
        df = b.df.select(*(b.col(n).alias(new.get(n, n)) for n in b.kinds), *([] if b.kinds else [F.lit(1).alias(".unit2")]))
        return Rel(df, {new.get(n, n): k for n, k in b.kinds.items()}, frozenset(new.get(n, n) for n in b.maybe)), new

    def condition(self, a: Rel, b: Rel, shared, new) -> Column:
        cond = F.lit(True)
        for n in shared:
            eq = a.col(n) == b.col(new[n])
            if n in a.maybe:
                eq = eq | a.col(n).isNull()
            if new[n] in b.maybe:
                eq = eq | b.col(new[n]).isNull()
            cond = cond & eq
        return cond

    def disjoint(self, a: Rel, b: Rel, shared) -> bool:
        return any(a.kinds[n].name == b.kinds[n].name == "iri" and a.kinds[n].prefix != b.kinds[n].prefix and n not in a.maybe | b.maybe for n in shared)

    # An unbound variable is compatible with any value. Rows with and without it are joined apart, so that each
    # part is an equi-join and none a comparison of all pairs.
    def having(self, r: Rel, n: str) -> Rel:
        return Rel(r.df.where(r.col(n).isNotNull()), r.kinds, r.maybe - {n})

    def lacking(self, r: Rel, n: str) -> Rel:
        """Rows where a variable is unbound, without it."""
        rest = [m for m in r.kinds if m != n]
        df = r.df.where(r.col(n).isNull()).select(*(map(r.col, rest) if rest else [F.lit(1).alias(".unit")]))
        return Rel(df, {m: r.kinds[m] for m in rest}, r.maybe - {n})

    def with_null(self, r: Rel, like: Rel, n: str) -> Rel:
        return Rel(r.df.withColumn(n, F.lit(None).cast(like.df.schema[n].dataType)), {**r.kinds, n: like.kinds[n]}, r.maybe | {n})

    def join(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in a.kinds if n in b.kinds]
        if self.disjoint(a, b, shared):
            return self.empty({*a.kinds, *b.kinds})
        a, b = self.aligned(a, b, shared)
        n = next((n for n in shared if n in a.maybe | b.maybe), None)
        if n is not None:
            parts = [self.join(self.having(a, n), self.having(b, n))]
            if n in a.maybe:
                parts.append(self.join(self.lacking(a, n), b))
            if n in b.maybe:
                parts.append(self.join(self.having(a, n), self.lacking(b, n)))
            return self.union(parts)
        b, new = self.renamed(b, shared)
        df = a.df.join(b.df, self.condition(a, b, shared, new), "inner") if shared else a.df.crossJoin(b.df)
        return self.joined(a, b, shared, new, df, a.maybe | b.maybe)

    def joined(self, a: Rel, b: Rel, shared, new, df, maybe) -> Rel:
        kinds = {**a.kinds, **{n: k for n, k in b.kinds.items() if n not in new.values()}}
        out = [F.coalesce(a.col(n), b.col(new[n])).alias(n) if n in new and n in a.maybe else F.col(f"`{n}`") for n in kinds]
        sure = {n for n in shared if n not in a.maybe or new[n] not in b.maybe}
        return Rel(df.select(*out) if kinds else df, kinds, frozenset(n for n in maybe if n in kinds and n not in sure))

    def left_join(self, a: Rel, b: Rel, expr) -> Rel:
        shared = [n for n in a.kinds if n in b.kinds]
        a, b = self.aligned(a, b, shared)
        n = next((n for n in shared if n in a.maybe), None)
        if n is not None:
            return self.union([self.left_join(self.having(a, n), b, expr), self.left_join(self.lacking(a, n), b, expr)])
        if any(n in b.maybe for n in shared):
            exprs = [] if expr is None else [expr]
            joined = self.join(a, b)
            for x in exprs:
                joined = self.filter(x, joined)
            return self.union([joined, self.matching(a, b, exprs, True)])
        b, new = self.renamed(b, shared)
        cond = self.condition(a, b, shared, new)
        if expr is not None:
            scope = {n: (b.col(n), k) for n, k in b.kinds.items() if n not in new.values()} | {n: (F.coalesce(a.col(n), b.col(new[n])) if n in new else a.col(n), k) for n, k in a.kinds.items()}
            cond = cond & F.coalesce(ebv(*evaluate(expr, Scope(scope))), F.lit(False))
        df = a.df.join(b.df, cond, "left_outer")
        return self.joined(a, b, shared, new, df, a.maybe | set(b.kinds))

    def union(self, parts: list[Rel]) -> Rel:
        names = list(dict.fromkeys(n for p in parts for n in p.kinds))
        kinds = {}
        for n in names:
            have = {p.kinds[n] for p in parts if n in p.kinds}
            kinds[n] = have.pop() if len(have) == 1 else TERM
        out = []
        for p in parts:
            p = p.as_terms({n for n in p.kinds if kinds[n] == TERM and p.kinds[n] != TERM})
            out.append(p.df.select(*(p.col(n) for n in names if n in p.kinds)) if p.kinds else p.df)
        maybe = frozenset(n for n in names if any(n not in p.kinds or n in p.maybe for p in parts))
        return Rel(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), out), kinds, maybe)

    def minus(self, a: Rel, b: Rel) -> Rel:
        shared = [n for n in a.kinds if n in b.kinds]
        if not shared or self.disjoint(a, b, shared):
            return a
        a, b = self.aligned(a, b, shared)
        n = next((n for n in shared if n in a.maybe), None)
        if n is not None:
            unbound = self.minus(self.lacking(a, n), b.select([m for m in b.kinds if m != n]))
            return self.union([self.minus(self.having(a, n), b), self.with_null(unbound, a, n)])
        n = next((n for n in shared if n in b.maybe), None)
        if n is not None:
            return self.minus(self.minus(a, self.having(b, n)), self.lacking(b, n))
        b, new = self.renamed(b.select(shared), shared)
        return Rel(a.df.join(b.df.distinct(), self.condition(a, b, shared, new), "left_anti"), a.kinds, a.maybe)

    def filter(self, e, rel: Rel, graphs=None) -> Rel:
        if isinstance(e, ast.Call) and e.name == "&&":
            return self.filter(e.args[1], self.filter(e.args[0], rel, graphs), graphs)
        if isinstance(e, ast.Call) and e.name == "!" and isinstance(e.args[0], ast.Exists):
            e = ast.Exists(e.args[0].pattern, not e.args[0].negated)
        if isinstance(e, ast.Exists):
            return self.exists(rel, e)
        rel, e = self.marked(rel, e)
        return Rel(rel.df.where(F.coalesce(ebv(*evaluate(e, self.scope(rel))), F.lit(False))), rel.kinds, rel.maybe)

    def exists(self, a: Rel, e: ast.Exists) -> Rel:
        inner, exprs = e.pattern, []
        while isinstance(inner, ast.Filter) and not isinstance(inner.expr, ast.Exists):
            exprs.append(inner.expr)  # may name variables of the outer pattern
            inner = inner.pattern
        graphs = self.graphs
        b = self.pattern(inner, graphs)
        self.graphs = graphs
        return self.matching(a, b, exprs, e.negated)

    def matching(self, a: Rel, b: Rel, exprs, negated: bool) -> Rel:
        """Rows of a with (negated: without) a compatible row of b for which the expressions hold."""
        shared = [n for n in a.kinds if n in b.kinds]
        a, b = self.aligned(a, b, shared)
        n = next((n for n in shared if n in a.maybe), None)
        if n is not None:
            return self.union([self.matching(self.having(a, n), b, exprs, negated), self.with_null(self.matching(self.lacking(a, n), b, exprs, negated), a, n)])
        n = next((n for n in shared if n in b.maybe), None)
        if n is not None:
            rest = self.matching(a, self.having(b, n), exprs, True)
            last = self.matching(rest, self.lacking(b, n), exprs, negated)
            return last if negated else self.union([self.matching(a, self.having(b, n), exprs, False), last])
        b, new = self.renamed(b, shared)
        cond = self.condition(a, b, shared, new)
        scope = {n: (b.col(n), k) for n, k in b.kinds.items() if n not in new.values()} | {n: (a.col(n), k) for n, k in a.kinds.items()}
        for x in exprs:
            cond = cond & F.coalesce(ebv(*evaluate(x, Scope(scope))), F.lit(False))
        return Rel(a.df.join(b.df, cond, "left_anti" if negated else "left_semi"), a.kinds, a.maybe)

    def marked(self, rel: Rel, e):
        """EXISTS within an expression: a mark on the rows, made of both cases."""
        if isinstance(e, ast.Exists):
            mark = self.fresh("mark")
            parts = [self.exists(rel, ast.Exists(e.pattern, negated)) for negated in (False, True)]
            marked = [Rel(p.df.withColumn(mark, F.lit(negated == e.negated)), {**p.kinds, mark: Kind("bool")}, p.maybe) for p, negated in zip(parts, (False, True))]
            return self.union(marked), ast.Var(mark)
        if isinstance(e, ast.Call):
            args = []
            for x in e.args:
                rel, x = self.marked(rel, x)
                args.append(x)
            return rel, ast.Call(e.name, tuple(args), e.distinct, e.sep)
        return rel, e

    # Triples.
    def bgp(self, triples, graphs) -> Rel:
        if not triples:
            return self.unit()
        plain = [t for t in triples if not isinstance(t[1], ast.Path)]
        paths = [t for t in triples if isinstance(t[1], ast.Path)]
        if self.optimizer:
            plain = self.optimizer(plain, graphs)
        parts = []
        if isinstance(self.source, VirtualGraphs):
            stars: dict = {}
            for t in plain:
                stars.setdefault(t[0], []).append(t)
            parts = [self.star(s, ts, graphs) for s, ts in stars.items()]
        else:
            parts = [self.scan(t, graphs) for t in plain]
        for s, p, o in paths:
            parts.append(self.bind_ends(self.path(p, graphs, s, o), s, o))
        # Joined in the given order, connected parts first.
        now, left = parts[0], parts[1:]
        while left:
            i = next((i for i, p in enumerate(left) if set(p.kinds) & set(now.kinds)), 0)
            now = self.join(now, left.pop(i))
        return now

    def restricted(self, rel: Rel, name: str, value) -> Rel:
        """rel where a column equals a constant term; without the column."""
        c, kind = rel.col(name), rel.kinds[name]
        if isinstance(value, ast.Iri):
            if kind.name == "iri":
                key = value.value[len(kind.prefix) :]
                cond = F.lit(False) if not value.value.startswith(kind.prefix) else c == (F.lit(key).try_cast("bigint") if rel.df.schema[name].dataType.simpleString() == "bigint" else F.lit(key))
            else:
                cond = c == F.lit(value.value) if kind.name == "term" else F.lit(False)
        elif kind.name == "term":
            cond = c == F.lit(constant(value))
        else:
            other, k = evaluate(value, Scope({}))
            cond = c == other if k == kind else F.lit(False)
        kinds = {n: k for n, k in rel.kinds.items() if n != name}
        return Rel(rel.df.where(cond), kinds, rel.maybe)

    def bind_ends(self, rel: Rel, s, o) -> Rel:
        """rel of columns .s and .o with its ends named or fixed."""
        for end, x in ((".s", s), (".o", o)):
            if not isinstance(x, ast.Var):
                rel = self.restricted(rel, end, x)
        if isinstance(s, ast.Var) and s == o:
            both = rel.as_terms({".s", ".o"}) if rel.kinds[".s"] != rel.kinds[".o"] else rel
            return Rel(both.df.where("`.s` = `.o`").select(both.col(".s").alias(s.name)), {s.name: both.kinds[".s"]})
        names = {end: x.name for end, x in ((".s", s), (".o", o)) if isinstance(x, ast.Var)}
        return Rel(rel.df.select(*(rel.col(e).alias(n) for e, n in names.items()), *([] if names else [F.lit(1).alias(".unit")])), {n: rel.kinds[e] for e, n in names.items()})

    def scan(self, t, graphs) -> Rel:
        s, p, o = t
        fixed = {k: constant(x) for k, x in zip("spo", t) if not isinstance(x, ast.Var)}
        df = self.source.scan(fixed, graphs)
        names: dict[str, str] = {}
        for k, x in zip("spo", (s, p, o)):
            if isinstance(x, ast.Var):
                if x.name in names:
                    df = df.where(F.col(k) == F.col(names[x.name]))
                else:
                    names[x.name] = k
        return Rel(df.select(*(F.col(k).alias(n) for n, k in names.items()), *([] if names else [F.lit(1).alias(".unit")])), {n: TERM for n in names})

    def star(self, s, triples, graphs) -> Rel:
        """All patterns of one subject over one table are one scan of it."""
        branches = []
        for urn in graphs:
            t = self.source.tables[urn[len(TAB) :]]
            rel = self.star_in(t, s, triples)
            if rel is not None:
                branches.append(rel)
        names = {x.name for t in triples for x in t if isinstance(x, ast.Var)}
        return self.union(branches) if branches else self.empty(names)

    def star_in(self, t, s, triples) -> Rel | None:
        if any(isinstance(p, ast.Iri) and not (p.value == _TYPE or p.value.startswith(COL) and p.value[len(COL) :] in t.columns) for _, p, _ in triples):
            return None
        kinds, columns = {".s": t.subject[1]}, [t.subject[0].alias(".s")]
        ends = []
        for _, p, o in triples:
            name = self.fresh("o")
            if isinstance(p, ast.Var):
                every = [F.struct(F.lit(COL + c).alias("p"), as_term(*v).alias("o")) for c, v in t.columns.items()]
                every.append(F.struct(F.lit(_TYPE).alias("p"), F.lit(CLASS + t.name.capitalize()).alias("o")))
                columns.append(F.explode(F.filter(F.array(*every), lambda x: x["o"].isNotNull())).alias(name))
                ends.append((name, p, o))
                kinds[name] = TERM
            else:
                c, kind = (F.lit(CLASS + t.name.capitalize()), TERM) if p.value == _TYPE else t.columns[p.value[len(COL) :]]
                columns.append(c.alias(name))
                kinds[name] = kind
                ends.append((name, None, o))
        source = t.wide if any(isinstance(p, ast.Var) or p.value[len(COL) :] in t.derived for _, p, _ in triples) and t.derived else t.df
        if sum(1 for _, p, _ in ends if p is not None) <= 1:
            df = source.select(*columns)
        else:  # one generator a projection
            df = reduce(lambda d, c: d.select("*", c), columns[1:], source.select("*", columns[0]))
        for name, p, _ in list(ends):
            if p is not None:
                df = df.withColumns({name + "p": F.col(f"`{name}`")["p"], name + "o": F.col(f"`{name}`")["o"]})
        rel = Rel(df, kinds)
        bound: dict[str, tuple[str, Kind]] = {}
        conds: list[tuple[str, object]] = [(".s", s)]
        for name, p, o in ends:
            if p is not None:
                rel.kinds[name + "p"] = rel.kinds[name + "o"] = TERM
                conds += [(name + "p", p), (name + "o", o)]
            else:
                conds.append((name, o))
        for name, x in conds:
            if isinstance(x, ast.Var):
                if x.name in bound:
                    other, kind = bound[x.name]
                    a, b = (rel.col(name), rel.col(other)) if rel.kinds[name] == kind else (as_term(rel.col(name), rel.kinds[name]), as_term(rel.col(other), kind))
                    rel = Rel(rel.df.where(a == b), rel.kinds)
                else:
                    bound[x.name] = (name, rel.kinds[name])
                    rel = Rel(rel.df.where(rel.col(name).isNotNull()), rel.kinds)
            else:
                keep = rel.kinds
                rel = Rel(self.restricted(rel, name, x).df, keep)
        out = [rel.col(c).alias(n) for n, (c, _) in bound.items()]
        return Rel(rel.df.select(*out, *([] if out else [F.lit(1).alias(".unit")])), {n: k for n, (_, k) in bound.items()})

    # Paths: relations of .s and .o.
    def path(self, p, graphs, s=None, o=None) -> Rel:
        s_, o_ = ast.Var(".s"), ast.Var(".o")
        if isinstance(p, ast.Iri):
            return self.bgp(((s_, p, o_),), graphs)
        if p.op == "inv":
            r = self.path(p.args[0], graphs, o, s)
            return Rel(r.df.select(r.col(".o").alias(".s"), r.col(".s").alias(".o")), {".s": r.kinds[".o"], ".o": r.kinds[".s"]})
        if p.op == "alt":
            return self.union([self.path(x, graphs, s, o) for x in p.args])
        if p.op == "seq":
            now = self.path(p.args[0], graphs, s)
            for x in p.args[1:]:
                r = self.path(x, graphs)
                mid = self.fresh("mid")
                left = Rel(now.df.select(now.col(".s"), now.col(".o").alias(mid)), {".s": now.kinds[".s"], mid: now.kinds[".o"]})
                right = Rel(r.df.select(r.col(".s").alias(mid), r.col(".o")), {mid: r.kinds[".s"], ".o": r.kinds[".o"]})
                now = self.join(left, right).select([".s", ".o"])
            return now
        if p.op == "neg":
            parts = []
            for inverse in (False, True):
                out = [i.value for i, v in p.args if v == inverse]
                if out or not inverse and not any(v for _, v in p.args):
                    r = self.bgp(((s_, ast.Var(".p"), o_),), graphs)
                    df = r.df.where(~r.col(".p").isin(*out)) if out else r.df
                    a, b = (".o", ".s") if inverse else (".s", ".o")
                    parts.append(Rel(df.select(r.col(a).alias(".s"), r.col(b).alias(".o")), {".s": r.kinds[a], ".o": r.kinds[b]}))
            return self.union(parts)
        edges = self.path(p.args[0], graphs)
        if edges.kinds[".s"] != edges.kinds[".o"]:
            edges = edges.as_terms({".s", ".o"})
        kind = edges.kinds[".s"]
        edges = Rel(edges.df.select("`.s`", "`.o`").distinct(), {".s": kind, ".o": kind})
        if p.op in ("plus", "star"):
            # From the fixed end, against the edges if only the far one is fixed.
            turned = (s is None or isinstance(s, ast.Var)) and o is not None and not isinstance(o, ast.Var)
            names = (".o", ".s") if turned else (".s", ".o")
            pairs = self.closure(edges.df.select(*(f"`{n}`" for n in names)), o if turned else s, kind)
            edges = Rel(pairs.toDF(*names).select("`.s`", "`.o`"), edges.kinds)
        if p.op in ("star", "opt"):
            edges = self.with_zero(edges, graphs, s, o)
        return edges

    def with_zero(self, edges: Rel, graphs, s, o) -> Rel:
        """Adds the zero-length pairs: of the fixed end, else of every node of the graphs."""
        fixed = next((x for x in (s, o) if x is not None and not isinstance(x, ast.Var)), None)
        if fixed is not None:
            node = Rel(self.spark.range(1).select(F.lit(constant(fixed)).alias(".n")), {".n": TERM})
        else:
            r = self.bgp(((ast.Var(".s"), ast.Var(".p"), ast.Var(".o")),), graphs).as_terms({".s", ".o"})
            node = Rel(r.df.select(r.col(".s").alias(".n")).union(r.df.select(r.col(".o"))).distinct(), {".n": TERM})
        zero = Rel(node.df.select(F.col("`.n`").alias(".s"), F.col("`.n`").alias(".o")), {".s": TERM, ".o": TERM})
        both = self.union([edges.as_terms({".s", ".o"}), zero])
        return Rel(both.df.distinct(), both.kinds)

    def closure(self, edges: DataFrame, s, kind: Kind) -> DataFrame:
        """Pairs joined by one edge or more, from s if it is fixed: each round extends new pairs only, and is written out."""
        from .scratch import materialize

        base = materialize(edges.toDF("a", "b"), "edges")
        start = base
        if s is not None and not isinstance(s, ast.Var):
            start = self.restricted(Rel(base.select(F.col("a").alias(".s"), F.col("a"), F.col("b")), {".s": kind, "a": kind, "b": kind}), ".s", s).df.select("a", "b")
        seen = frontier = materialize(start, "paths")
        rounds = 0
        while not frontier.isEmpty():
            rounds += 1
            if rounds % 8 == 0:
                seen = materialize(seen, "paths")  # one scan for eight
            step = frontier.toDF("a", "m").join(base.toDF("m", "b"), "m").select("a", "b").distinct()
            frontier = materialize(step.join(seen, ["a", "b"], "left_anti"), "paths")
            seen = seen.union(frontier)
        return seen


def _term_total(call: ast.Call, c: Column, kind: Kind) -> Column:
    """SUM or AVG by the types that the literals name, of the widest of them; NULL where one is no number."""
    x = (F.when(c.isNotNull(), c), kind)
    place = rank(*x)
    add = F.sum_distinct if call.distinct else F.sum
    many = F.count_distinct if call.distinct else F.count
    # Each type is summed on its own, exactly where it can be: decimals of a sum have ten digits more.
    none = lambda t: F.lit(0).cast(t)
    whole = F.coalesce(add(F.when(place == 0, exact(*x, "decimal(28,0)"))), none("decimal(38,0)"))
    part = F.coalesce(add(F.when(place == 1, exact(*x, "decimal(28,18)"))), none("decimal(38,18)"))
    rest = F.coalesce(add(F.when(place >= 2, native(*x, "double"))), none("double"))
    widest, n = F.coalesce(F.max(place), F.lit(0)), many(c)
    decimal = (whole.cast("decimal(38,18)") + part).cast("decimal(38,18)")
    double = decimal.cast("double") + rest
    if call.name == "AVG":
        widest = F.when((widest == 0) & (n > 0), F.lit(1)).otherwise(widest)
        decimal, double = F.try_divide(decimal, n).cast("decimal(38,18)"), F.try_divide(double, n)
    return F.when(F.count_if(c.isNotNull() & place.isNull()) == 0, number_term(widest, whole.cast("decimal(38,0)"), decimal, double))


def construct(c: Compiler, q: ast.Query) -> DataFrame:
    """The set of triples of the template over all solutions; blank nodes of the template are new in each solution,
    and triples with an unbound or unfit term are left out."""
    rel = c.query(q)
    own = {x for t in q.template for x in t if isinstance(x, ast.Var) and x.name.startswith(".") and x.name not in rel.kinds}
    df = rel.df.withColumn(".row", F.monotonically_increasing_id()) if own else rel.df
    number = {v: i for i, v in enumerate(sorted(own, key=lambda v: v.name))}

    def term(x) -> Column:
        if not isinstance(x, ast.Var):
            return F.lit(constant(x))
        if x in number:
            return F.concat(F.lit(f"_:c{number[x]}n"), F.col("`.row`").cast("string"))
        return as_term(rel.col(x.name), rel.kinds[x.name]) if x.name in rel.kinds else F.lit(None).cast("string")

    every = F.array(*(F.struct(*(term(x).alias(k) for k, x in zip("spo", t))) for t in q.template))
    out = df.select(F.explode(every).alias("t")).select("t.*") if q.template else c.spark.createDataFrame([], "s string, p string, o string")
    fit = F.col("o").isNotNull() & ~F.col("s").startswith('"') & ~F.col("p").startswith('"') & ~F.col("p").startswith("_:")
    return out.where(fit).distinct()


def describe(c: Compiler, q: ast.Query) -> DataFrame:
    """All triples of the described nodes, and of the blank nodes reached by them through blank nodes."""
    from .scratch import materialize

    rel = c.query(q)
    names = [v.name for v in q.terms if isinstance(v, ast.Var) and v.name in rel.kinds] if q.terms else [n for n in rel.kinds if not n.startswith(".")]
    nodes = [rel.df.select(as_term(rel.col(n), rel.kinds[n]).alias("s")) for n in names]
    fixed = [(constant(t),) for t in q.terms if isinstance(t, ast.Iri)]
    if fixed:
        nodes.append(c.spark.createDataFrame(fixed, "s string"))
    graphs = [i.value for i in q.sources] if q.sources else c.source.urns
    r = c.bgp(((ast.Var("s"), ast.Var("p"), ast.Var("o")),), [g for g in graphs if g in c.source.urns]).as_terms({"s", "p", "o"})
    triples = r.df.select("s", "p", "o")
    if not nodes:
        return triples.limit(0)
    todo = reduce(lambda a, b: a.union(b), nodes).where(F.col("s").isNotNull()).distinct()
    found = materialize(triples.join(todo, "s", "left_semi").distinct(), "described")
    last = found
    while True:
        blank = last.where(F.col("o").startswith("_:")).select(F.col("o").alias("s")).distinct()
        blank = materialize(blank.join(found.select("s").distinct(), "s", "left_anti"), "blank")
        if blank.isEmpty():
            return found.select("s", "p", "o")
        last = materialize(triples.join(blank, "s", "left_semi").distinct(), "described")
        found = found.union(last)


class SparqlUnsupported(NotImplementedError):
    pass


def constant(x) -> str:
    return x.value if isinstance(x, ast.Iri) else literal(x.lex, x.dt, x.lang)
