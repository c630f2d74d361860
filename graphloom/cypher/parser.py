"""Recursive-descent parser of the supported statements; anything else is refused with a reason."""

from __future__ import annotations

import re
from collections.abc import Mapping

from graphloom.cypher.ast import (
    Aggregate, And, Batch, Compare, CreateEdges, Delete, Edge, Group, Item, Literal, MergeEdge, Node, Not, Or, PathCall,
    Prop, Read, RemoveLabels, RemoveProp, RowField, SetLabels, SetProp, Sort, StartsWith, Union_, Update,
)
from graphloom.cypher.lexer import Token, tokens
from graphloom.errors import LimitExceeded, MissingParameter, ParseError, Unsupported

MAX_UNION_ARMS = 256
AGGREGATES = ("count", "sum", "avg", "collect")
#: Properties that steer a guarded batch instead of being stored.
GUARD_MARK, CREATE_ONLY_MARK = "__update_if_newer_by", "__create_only_"
_COMPONENT = re.compile(r"[A-Za-z0-9_.-]+\Z")


def check_name(kind: str, name: str) -> str:
    if not _COMPONENT.match(name):
        raise Unsupported(f"{kind} {name!r} may hold letters, digits, _ . and - only")
    return name


class Parser:
    def __init__(self, text: str, params: Mapping[str, object] | None = None, max_hops: int = 16):
        self.toks, self.at = tokens(text), 0
        self.params, self.max_hops = dict(params or {}), max_hops
        self.row: str | None = None  # the alias of UNWIND
        self.fresh = 0

    # tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.at]

    def next(self) -> Token:
        self.at += 1
        return self.toks[self.at - 1]

    def is_op(self, *ops: str) -> bool:
        return self.tok.kind == "op" and self.tok.text in ops

    def op(self, text: str) -> bool:
        if self.is_op(text):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.op(text):
            raise ParseError(f"expected {text!r} at {self.tok.at}, found {self.tok.text!r}")

    def is_word(self, *words: str) -> bool:
        ahead = self.toks[self.at : self.at + len(words)]
        return len(ahead) == len(words) and all(t.kind == "name" and not t.quoted and t.text.upper() == w for t, w in zip(ahead, words))

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += len(words)
            return True
        return False

    def need_word(self, word: str) -> None:
        if not self.word(word):
            raise ParseError(f"expected {word} at {self.tok.at}, found {self.tok.text!r}")

    def name(self, kind: str = "name") -> str:
        if self.tok.kind != "name":
            raise ParseError(f"expected a {kind} at {self.tok.at}, found {self.tok.text!r}")
        return self.next().text

    def end(self) -> None:
        self.op(";")
        if self.tok.kind != "end":
            raise Unsupported(f"clause not supported here: {self.tok.text!r} at {self.tok.at}")

    # values

    def param(self, name: str) -> object:
        if name not in self.params:
            raise MissingParameter(f"parameter ${name} is missing")
        return self.params[name]

    def scalar(self, rows: bool = False) -> object:
        """A literal, a parameter, or in batches a field of the row."""
        sign = None
        while self.is_op("-", "+"):
            sign = -1 if (self.next().text == "-") != (sign == -1) else 1
        t = self.next()
        if t.kind == "int":
            value = int(t.text)
            if sign == -1:
                if value == 0:
                    return -0.0
                value = -value
            if not -(1 << 63) <= value < 1 << 63:
                raise Unsupported(f"integer {value} does not fit 64 bits")
            return value
        if t.kind == "float":
            return float(t.text) * (-1 if sign == -1 else 1)
        if sign is not None:
            raise Unsupported("a sign stands in front of numbers only")
        if t.kind == "string":
            return t.text
        if t.kind == "param":
            value = self.param(t.text)
            if not isinstance(value, (bool, int, float, str)):
                raise Unsupported(f"parameter ${t.text} must be a scalar")
            return value
        if t.kind == "name" and t.text.lower() in ("true", "false"):
            return t.text.lower() == "true"
        if rows and t.kind == "name" and t.text == self.row:
            self.need(".")
            return RowField(self.name("field"))
        raise Unsupported(f"expected a scalar value at {t.at}, found {t.text!r}")

    def whole(self, what: str) -> int:
        """Constant integer arithmetic of SKIP and LIMIT."""
        value = self._sum(what)
        if value < 0:
            raise Unsupported(f"{what} cannot be negative")
        return value

    def _sum(self, what: str) -> int:
        value = self._product(what)
        while self.is_op("+", "-"):
            value = value + self._product(what) if self.next().text == "+" else value - self._product(what)
        return value

    def _product(self, what: str) -> int:
        value = self._unit(what)
        while self.is_op("*", "/", "%"):
            op, other = self.next().text, None
            other = self._unit(what)
            if op == "*":
                value *= other
            elif other == 0:
                raise Unsupported(f"{what} divides by zero")
            else:  # toward zero
                quotient = abs(value) // abs(other) * (1 if (value < 0) == (other < 0) else -1)
                value = quotient if op == "/" else value - quotient * other
        return value

    def _unit(self, what: str) -> int:
        if self.op("-"):
            return -self._unit(what)
        if self.op("+"):
            return self._unit(what)
        if self.op("("):
            value = self._sum(what)
            self.need(")")
            return value
        t = self.next()
        value = int(t.text) if t.kind == "int" else self.param(t.text) if t.kind == "param" else None
        if isinstance(value, bool) or not isinstance(value, int):
            raise Unsupported(f"{what} takes constant integer arithmetic only")
        return value

    # patterns

    def labels(self) -> tuple[str, ...]:
        out = []
        while self.op(":"):
            out.append(check_name("label", self.name("label")))
        return tuple(dict.fromkeys(out))

    def prop_map(self, rows: bool) -> list[tuple[str, object]]:
        out = []
        self.need("{")
        while not self.op("}"):
            if out:
                self.need(",")
            key = check_name("property", self.name("property"))
            self.need(":")
            out.append((key, self.scalar(rows)))
        return out

    def node(self, rows: bool = False, creating: bool = False) -> Node:
        self.need("(")
        var = self.name("variable") if self.tok.kind == "name" else None
        labels, props = self.labels(), []
        if self.is_op("{"):
            props = self.prop_map(rows)
        elif self.tok.kind == "param":
            raise Unsupported("a map of properties must be written out")
        self.need(")")
        ident = None
        for key, value in props:
            if key == "id":
                if isinstance(value, bool) or not isinstance(value, (int, RowField)):
                    raise Unsupported("node id must be an integer")
                if isinstance(value, int) and value < 0:
                    raise Unsupported("node id cannot be negative")
                ident = value
        rest = tuple((k, v) for k, v in props if k != "id")
        if var is None and not creating and (labels or rest):
            raise Unsupported("node labels and properties other than id require a named node")
        if var is None:
            self.fresh += 1
        return Node(var or f"#{self.fresh}", labels, ident, rest, var is None)

    def path(self, rows: bool = False, creating: bool = False) -> list[Node | Edge]:
        if self.tok.kind == "name" and self.toks[self.at + 1].text == "=":
            raise Unsupported("path variables are not supported")
        left = self.node(rows, creating)
        out: list[Node | Edge] = []
        while self.is_op("-", "<-"):
            back = self.next().text == "<-"
            var, kind, props, hops = None, None, (), None
            if self.op("["):
                if self.tok.kind == "name":
                    var = self.name()
                if self.op(":"):
                    kind = check_name("relationship type", self.name("type"))
                    if self.is_op("|"):
                        raise Unsupported("a relationship pattern has exactly one type")
                if self.op("*"):
                    hops = self.hops()
                if self.is_op("{"):
                    props = tuple(self.prop_map(rows))
                self.need("]")
            if kind is None:
                raise Unsupported("a relationship pattern has exactly one type")
            if self.op("->"):
                forward = True
            else:
                self.need("-")
                forward = False
            if back == forward:
                raise Unsupported("undirected relationships are not supported")
            right = self.node(rows, creating)
            if hops and var:
                raise Unsupported("a relationship of variable length has no variable")
            if hops and props:
                raise Unsupported("a relationship of variable length has no properties")
            src, dst = (right, left) if back else (left, right)
            out.append(Edge(src, dst, kind, var, props, hops))
            left = right
        return out or [left]

    def hops(self) -> tuple[int, int]:
        def count() -> int | None:
            return int(self.next().text) if self.tok.kind == "int" else None

        low = count()
        if self.op(".."):
            high = count()
        else:
            high = low
        if high is None:
            raise Unsupported("a variable length needs an explicit largest hop count")
        low = 1 if low is None else low
        if low > high:
            raise Unsupported("the range of hops is empty")
        if high > 255:
            raise Unsupported("hop counts go up to 255")
        if high > self.max_hops:
            raise LimitExceeded(f"{high} hops are over the limit of {self.max_hops}")
        return low, high

    def patterns(self) -> tuple[Node | Edge, ...]:
        out = self.path()
        while self.op(","):
            out += self.path()
        return tuple(out)

    # predicates

    def predicate(self) -> object:
        left = self._and()
        while True:
            if self.word("OR"):
                left = Or(left, self._and())
            elif self.is_word("XOR"):
                raise Unsupported("XOR is not supported")
            else:
                return left

    def _and(self) -> object:
        left = self._not()
        while self.word("AND"):
            left = And(left, self._not())
        return left

    def _not(self) -> object:
        return Not(self._not()) if self.word("NOT") else self._comparison()

    def _comparison(self) -> object:
        if self.is_op("("):  # a predicate or an operand in parentheses
            start = self.at
            self.next()
            try:
                inner = self.predicate()
                self.need(")")
                if not self.is_op("=", "<>", "<", ">", "<=", ">="):
                    return inner
            except (ParseError, Unsupported):
                pass
            self.at = start
        left = self._operand()
        if self.word("STARTS", "WITH"):
            prefix = self._operand()
            if not isinstance(prefix, Literal) or not isinstance(prefix.value, str):
                raise Unsupported("STARTS WITH takes a string")
            return StartsWith(left, prefix.value)
        pairs, first = [], left
        while self.is_op("=", "<>", "<", ">", "<=", ">="):
            op = self.next().text
            right = self._operand()
            pairs.append(Compare(op, first, right))
            first = right
        if not pairs:
            raise Unsupported(f"predicate not supported at {self.tok.at}: {self.tok.text!r}")
        out = pairs[0]
        for p in pairs[1:]:
            out = And(out, p)
        return out

    def _operand(self) -> Prop | Literal:
        if self.op("("):
            inner = self._operand()
            self.need(")")
            return inner
        t = self.tok
        if t.kind == "name" and t.text.lower() not in ("true", "false") and self.toks[self.at + 1].text == ".":
            return self.prop()
        return Literal(self.scalar())

    def prop(self) -> Prop:
        var = self.name("variable")
        self.need(".")
        return Prop(var, self.name("property"))

    # reads

    def match(self, optional: bool) -> Group:
        patterns = self.patterns()
        if self.is_word("USING"):
            raise Unsupported("MATCH hints are not supported")
        where = self.predicate() if self.word("WHERE") else None
        return Group(patterns, where, optional)

    def expression(self) -> Prop | Aggregate:
        t = self.tok
        if t.kind == "name" and self.toks[self.at + 1].text == "(":
            fn = t.text.lower()
            if fn not in AGGREGATES:
                raise Unsupported(f"function {t.text} is not supported")
            self.at += 2
            if self.is_word("DISTINCT"):
                raise Unsupported("DISTINCT inside of an aggregate is not supported")
            if self.op("*"):
                if fn != "count":
                    raise Unsupported(f"{fn}(*) is not supported")
                of = None
            else:
                of = self._operand()
            self.need(")")
            return Aggregate(fn, of)
        if t.kind == "name" and self.toks[self.at + 1].text == ".":
            return self.prop()
        raise Unsupported("RETURN takes binding.property and aggregates only")

    def returned(self, groups: list[Group]) -> Read:
        distinct = self.word("DISTINCT")
        if self.is_op("*"):
            raise Unsupported("RETURN * is not supported")
        items = []
        while True:
            of = self.expression()
            name = self.name("alias") if self.word("AS") else default_name(of)
            items.append(Item(of, name))
            if not self.op(","):
                break
        names = [i.name for i in items]
        if len(set(names)) < len(names):
            raise Unsupported("two result columns have the same name")
        order = []
        if self.word("ORDER", "BY"):
            while True:
                ahead = self.toks[self.at + 1].text
                key = self.expression() if ahead in (".", "(") else self.name("column")
                if isinstance(key, Aggregate) and key.of is not None:
                    raise Unsupported("ORDER BY takes aliases, properties and count(*)")
                down = self.word("DESC") or self.word("DESCENDING")
                if not down and not self.word("ASC"):
                    self.word("ASCENDING")
                order.append(Sort(key, not down))
                if not self.op(","):
                    break
        skip = self.whole("SKIP") if self.word("SKIP") else 0
        limit = self.whole("LIMIT") if self.word("LIMIT") else None
        read = Read(tuple(groups), tuple(items), distinct, tuple(order), skip, limit)
        projected = {i.of for i in items} | set(names)
        for s in order:
            if isinstance(s.of, str) and s.of not in names:
                raise Unsupported(f"ORDER BY {s.of}: no such column")
            if distinct and s.of not in projected:
                raise Unsupported("with DISTINCT, ORDER BY takes what RETURN projects")
            if any(isinstance(i.of, Aggregate) for i in items) and not isinstance(s.of, (str, Aggregate)) and s.of not in projected:
                raise Unsupported("with aggregates, ORDER BY takes aliases and count(*)")
            if isinstance(s.of, Aggregate) and s.of not in projected:
                raise Unsupported("ORDER BY count(*) needs count(*) in RETURN")
        return read

    def with_(self, groups: list[Group]) -> None:
        bound = {v for g in groups for p in g.patterns for v in bindings(p)}
        if not bound:
            raise Unsupported("WITH needs bindings in front of it")
        if self.is_word("DISTINCT") or self.is_op("*"):
            raise Unsupported("WITH passes bare bindings through, nothing else")
        seen = []
        while True:
            var = self.name("binding")
            if self.is_op(".", "("):
                raise Unsupported("WITH passes bare bindings through, nothing else")
            if self.word("AS") and self.name("alias") != var:
                raise Unsupported("WITH cannot rename")
            seen.append(var)
            if not self.op(","):
                break
        if self.is_word("WHERE") or self.is_word("ORDER", "BY") or self.is_word("SKIP") or self.is_word("LIMIT"):
            raise Unsupported("WITH passes bare bindings through, nothing else")
        if sorted(seen) != sorted(bound):
            raise Unsupported("WITH must pass every binding exactly once")

    def read_or_update(self) -> Read | Update:
        groups: list[Group] = []
        while True:
            if self.word("OPTIONAL", "MATCH"):
                groups.append(self.match(True))
            elif self.word("MATCH"):
                groups.append(self.match(False))
            elif self.word("WITH"):
                self.with_(groups)
            elif self.word("RETURN"):
                if not groups:
                    raise Unsupported("RETURN needs a MATCH in front of it")
                return self.returned(groups)
            elif groups and any(self.is_word(w) for w in ("SET", "REMOVE", "DELETE", "DETACH")):
                return self.update(groups)
            else:
                raise Unsupported(f"clause not supported: {self.tok.text or 'end of text'!r}")

    def statement(self) -> object:
        if self.is_word("CALL"):
            return self.call()
        if self.is_word("UNWIND"):
            return self.unwind()
        if self.word("CREATE"):
            if self.is_word("UNIQUE"):
                raise Unsupported("CREATE UNIQUE is not supported")
            edges = []
            while True:
                edges.append(self.created("CREATE", False))
                if not self.op(","):
                    break
            self.end()
            if len(edges) > 1 and any(e.props or e.src.constrained or e.dst.constrained for e in edges):
                raise Unsupported("CREATE of several paths takes no labels or properties")
            return CreateEdges(tuple(edges))
        if self.word("MERGE"):
            edge = self.created("MERGE", False)
            if self.is_word("ON"):
                raise Unsupported("MERGE has no ON CREATE or ON MATCH")
            self.end()
            return MergeEdge(edge)
        if any(self.is_word(w) for w in ("SET", "REMOVE", "DELETE", "DETACH")):
            raise Unsupported("DELETE, SET and REMOVE need a MATCH in front of them")
        arms, every = [self.read_or_update()], None
        while self.word("UNION"):
            if not isinstance(arms[-1], Read):
                raise Unsupported("UNION joins reads only")
            this = self.word("ALL")
            if every is not None and every != this:
                raise Unsupported("UNION and UNION ALL cannot be mixed")
            every = this
            arms.append(self.read_or_update())
        self.end()
        if len(arms) == 1:
            return arms[0]
        if not all(isinstance(a, Read) for a in arms):
            raise Unsupported("UNION joins reads only")
        if len(arms) > MAX_UNION_ARMS:
            raise LimitExceeded(f"UNION has at most {MAX_UNION_ARMS} arms")
        if any(a.columns != arms[0].columns for a in arms):
            raise Unsupported("UNION arms must have the same columns in the same order")
        return Union_(tuple(arms), every)

    # writes

    def created(self, verb: str, rows: bool) -> Edge:
        parts = self.path(rows, creating=True)
        if len(parts) != 1 or not isinstance(parts[0], Edge):
            raise Unsupported(f"{verb} takes paths of one relationship")
        edge = parts[0]
        if edge.hops:
            raise Unsupported(f"{verb} has no variable length")
        if edge.src.id is None or edge.dst.id is None:
            raise Unsupported(f"{verb} needs the ids of both nodes")
        return edge

    def update(self, groups: list[Group]) -> Update:
        if any(g.optional for g in groups):
            raise Unsupported("writes after OPTIONAL MATCH are not supported")
        actions: list[object] = []
        while True:
            if self.word("SET"):
                actions += self.items(self.set_item)
            elif self.word("REMOVE"):
                actions += self.items(self.remove_item)
            elif self.is_word("DETACH", "DELETE") or self.is_word("DELETE"):
                detach = self.word("DETACH")
                self.need_word("DELETE")
                actions += self.items(lambda: [Delete(self.name("variable"), detach)])
                if self.is_op("."):
                    raise Unsupported("DELETE takes node and relationship variables")
            else:
                break
        self.end()
        bound = {v for g in groups for p in g.patterns for v in bindings(p)}
        for a in actions:
            if a.var not in bound:
                raise Unsupported(f"{a.var} is not bound")
        return Update(tuple(groups), tuple(actions))

    def items(self, one) -> list[object]:
        out = list(one())
        while self.op(","):
            out += one()
        return out

    def set_item(self) -> list[object]:
        var = self.name("variable")
        if self.is_op(":"):
            return [SetLabels(var, self.labels())]
        if self.is_op("=") or self.is_op("+"):
            raise Unsupported("SET of a whole map is not supported")
        self.need(".")
        name = check_name("property", self.name("property"))
        if name.lower() == "id":
            raise Unsupported("SET cannot change an id")
        self.need("=")
        return [SetProp(var, name, self.scalar())]

    def remove_item(self) -> list[object]:
        var = self.name("variable")
        if self.is_op(":"):
            return [RemoveLabels(var, self.labels())]
        self.need(".")
        name = check_name("property", self.name("property"))
        if name.lower() == "id":
            raise Unsupported("REMOVE cannot take an id away")
        return [RemoveProp(var, name)]

    # batches

    def unwind(self) -> Batch:
        self.need_word("UNWIND")
        if self.tok.kind != "param":
            raise Unsupported("UNWIND takes a parameter")
        rows = self.param(self.next().text)
        if not isinstance(rows, (list, tuple)) or not all(isinstance(r, Mapping) for r in rows):
            raise Unsupported("UNWIND takes a list of maps")
        self.need_word("AS")
        self.row = self.name("alias")
        rows = tuple(dict(r) for r in rows)
        if self.word("CREATE"):
            edge = self.created("CREATE", True)
            if edge.props or edge.src.constrained or edge.dst.constrained:
                raise Unsupported("UNWIND ... CREATE of ids takes no labels or properties")
            self.end()
            return Batch("create", rows, edge=self._fields(edge))
        if self.word("MERGE"):
            node = self.node(True, True)
            if not isinstance(node.id, RowField) or node.constrained or node.anonymous:
                raise Unsupported("UNWIND ... MERGE takes (n {id: row.field})")
            labels, fields = self.batch_set(node.var)
            self.end()
            return self._guarded(Batch("upsert_nodes", rows, node=node, labels=labels, fields=fields))
        self.need_word("MATCH")
        parts = self.path(True)
        while self.op(","):
            parts += self.path(True)
        if self.is_word("WHERE"):
            raise Unsupported("UNWIND ... MATCH takes no WHERE")
        if self.word("RETURN"):
            return self.batch_read(rows, parts)
        if self.word("CREATE"):
            return self.batch_bound(rows, parts, "CREATE")
        if self.word("MERGE"):
            return self.batch_bound(rows, parts, "MERGE")
        detach = self.word("DETACH")
        self.need_word("DELETE")
        var = self.name("variable")
        self.end()
        if len(parts) != 1:
            raise Unsupported("UNWIND ... DELETE takes one pattern")
        part = parts[0]
        if isinstance(part, Node):
            if part.var != var or not isinstance(part.id, RowField) or part.constrained:
                raise Unsupported("UNWIND ... DELETE takes (n {id: row.field})")
            return Batch("delete_nodes", rows, node=part, detach=detach)
        if part.hops or part.var != var or detach:
            raise Unsupported("UNWIND ... DELETE takes the variable of its relationship")
        if isinstance(part.src.id, RowField) and isinstance(part.dst.id, RowField) and not part.props:
            return Batch("delete_edges", rows, edge=part)
        if part.src.id is None and part.dst.id is None and part.props and all(isinstance(v, RowField) for _, v in part.props):
            return Batch("delete_by_props", rows, edge=part)
        raise Unsupported("UNWIND ... DELETE takes ids of both nodes or properties of the relationship")

    def batch_read(self, rows: tuple, parts: list) -> Batch:
        edge = parts[0] if len(parts) == 1 else None
        if not isinstance(edge, Edge) or edge.hops or edge.props or not isinstance(edge.src.id, RowField) or edge.dst.id is not None or edge.src.constrained or edge.dst.constrained:
            raise Unsupported("UNWIND ... RETURN takes (a {id: row.field})-[:T]->(b)")
        columns = []
        for want in (Prop(self.row, edge.src.id.name), Prop(edge.dst.var, "id")):
            if columns:
                self.need(",")
            got = self.prop()
            if got != want:
                raise Unsupported(f"UNWIND ... RETURN takes {self.row}.{edge.src.id.name} and {edge.dst.var}.id")
            columns.append(self.name("alias") if self.word("AS") else f"{got.var}.{got.name}")
        self.end()
        return Batch("out_neighbors", rows, edge=edge, columns=tuple(columns))

    def batch_bound(self, rows: tuple, parts: list, verb: str) -> Batch:
        """MATCH (s {id}), (d {id}) CREATE or MERGE (s)-[r:T {...}]->(d)."""
        ends = {p.var: p for p in parts if isinstance(p, Node)}
        if len(ends) != 2 or len(parts) != 2 or any(not isinstance(p.id, RowField) or p.props for p in parts):
            raise Unsupported(f"UNWIND ... MATCH ... {verb} takes two nodes by id")
        path = self.path(True, creating=True)
        edge = path[0]
        if len(path) != 1 or not isinstance(edge, Edge) or edge.hops or {edge.src.var, edge.dst.var} != set(ends) or edge.src.constrained or edge.dst.constrained:
            raise Unsupported(f"{verb} takes one relationship between the matched nodes")
        edge = Edge(ends[edge.src.var], ends[edge.dst.var], edge.type, edge.var, edge.props)
        if any(not isinstance(v, RowField) for _, v in edge.props):
            raise Unsupported("relationship properties of a batch come from the row")
        if verb == "CREATE":
            self.end()
            if not edge.props:
                return Batch("create_bound", rows, edge=edge)
            if "id" not in dict(edge.props):
                raise Unsupported("CREATE with properties needs {id: row.field}")
            return Batch("create_relationships", rows, edge=edge, fields=tuple((k, v.name) for k, v in edge.props))
        if [k for k, _ in edge.props] != ["id"]:
            raise Unsupported("MERGE of a relationship takes {id: row.field}")
        labels, fields = self.batch_set(edge.var) if self.is_word("SET") else ((), ())
        if labels:
            raise Unsupported("relationships have no labels")
        self.end()
        return self._guarded(Batch("upsert_relationships", rows, edge=edge, fields=fields))

    def batch_set(self, var: str | None) -> tuple[tuple[str, ...], tuple[tuple[str, str], ...]]:
        labels: list[str] = []
        fields: list[tuple[str, str]] = []
        while self.word("SET"):
            while True:
                if var is None or self.name("variable") != var:
                    raise Unsupported("SET takes the merged variable")
                if self.is_op(":"):
                    labels += self.labels()
                else:
                    self.need(".")
                    key = check_name("property", self.name("property"))
                    self.need("=")
                    value = self.scalar(True)
                    if key == GUARD_MARK or key.startswith(CREATE_ONLY_MARK):
                        fields.append((key, value if isinstance(value, str) else ""))
                    elif not isinstance(value, RowField) or key.lower() == "id":
                        raise Unsupported("SET of a batch takes property = row.field")
                    else:
                        fields.append((key, value.name))
                if not self.op(","):
                    break
        return tuple(dict.fromkeys(labels)), tuple(fields)

    def _guarded(self, batch: Batch) -> Batch:
        """Take the marks out of the fields and check them."""
        guard = next((v for k, v in batch.fields if k == GUARD_MARK), None)
        only = tuple(k.removeprefix(CREATE_ONLY_MARK) for k, _ in batch.fields if k.startswith(CREATE_ONLY_MARK))
        fields = tuple((k, v) for k, v in batch.fields if k != GUARD_MARK and not k.startswith(CREATE_ONLY_MARK))
        check_guard(fields, guard, only)
        return Batch(batch.form, batch.rows, batch.edge, batch.node, batch.labels, fields, guard=guard, create_only=only)

    def _fields(self, edge: Edge) -> Edge:
        if not isinstance(edge.src.id, RowField) or not isinstance(edge.dst.id, RowField):
            raise Unsupported("UNWIND ... CREATE takes ids from the row")
        return edge

    # path procedures

    def call(self) -> PathCall:
        self.need_word("CALL")
        if self.name("procedure").lower() != "algo":
            raise Unsupported("CALL takes algo.SPpaths, algo.SSpaths and algo.MSpaths")
        self.need(".")
        kind = {"sppaths": "SPpaths", "sspaths": "SSpaths", "mspaths": "MSpaths"}.get(self.name("procedure").lower())
        if kind is None:
            raise Unsupported("CALL takes algo.SPpaths, algo.SSpaths and algo.MSpaths")
        self.need("(")
        config: dict[str, object] = {}
        self.need("{")
        while not self.op("}"):
            if config:
                self.need(",")
            key = self.name("option")
            if key in config:
                raise ParseError(f"option {key} is given twice")
            self.need(":")
            config[key] = self._config()
        self.need(")")
        self.need_word("YIELD")
        yielded = self._path_columns()
        self.need_word("RETURN")
        columns = self._path_columns()
        self.end()
        if not set(columns) <= set(yielded):
            raise Unsupported("RETURN takes yielded columns only")
        return PathCall(kind, config, tuple(columns))

    def _config(self) -> object:
        if self.op("["):
            out = []
            while not self.op("]"):
                if out:
                    self.need(",")
                out.append(self._config())
            return out
        if self.word("NULL"):
            return None
        if self.tok.kind == "param":
            return self.param(self.next().text)
        return self.scalar()

    def _path_columns(self) -> list[str]:
        known = {"path": "path", "pathweight": "pathWeight", "pathcost": "pathCost"}
        out = []
        while True:
            name = self.name("column")
            if name.lower() not in known:
                raise Unsupported(f"path procedures yield path, pathWeight and pathCost, not {name}")
            out.append(known[name.lower()])
            if not self.op(","):
                return out


def check_guard(fields: tuple[tuple[str, str], ...], guard: str | None, only: tuple[str, ...]) -> None:
    given = dict(fields)
    if guard is None and only:
        raise Unsupported("create-only properties need an update guard")
    if guard is not None and guard in only:
        raise Unsupported("the update guard cannot be create-only")
    for name in (*([guard] if guard is not None else []), *only):
        if given.get(name) != name:
            raise Unsupported(f"{name} must be a property set from the row field of the same name")


def default_name(of: Prop | Aggregate) -> str:
    if isinstance(of, Prop):
        return f"{of.var}.{'id' if of.is_id else of.name}"
    if of.of is None:
        return "count(*)"
    arg = of.of
    return f"{of.fn}({default_name(arg) if isinstance(arg, Prop) else str(arg.value).lower() if isinstance(arg.value, bool) else arg.value})"


def bindings(pattern: Node | Edge) -> list[str]:
    """Named bindings of a pattern."""
    if isinstance(pattern, Node):
        return [] if pattern.anonymous else [pattern.var]
    return [*([pattern.var] if pattern.var else []), *bindings(pattern.src), *bindings(pattern.dst)]


def parse(text: str, params: Mapping[str, object] | None = None, max_hops: int = 16) -> object:
    return Parser(text, params, max_hops).statement()
