"""SPARQL subset compiled to DataFrames over a triple table.

Covered: PREFIX/BASE, SELECT (DISTINCT, *, expressions AS), ASK, basic graph patterns with ``;`` ``,`` and ``a``, FILTER,
EXISTS / NOT EXISTS, OPTIONAL, UNION, MINUS, VALUES, BIND, sub-SELECT, GROUP BY, HAVING, aggregates, ORDER BY, LIMIT,
OFFSET. Property paths, GRAPH, SERVICE, CONSTRUCT, DESCRIBE and updates are rejected.

Inside a plan a term is one string, so that joins compare whole terms: a URI as it is, a blank node as ``_:x``, a literal
as ``"`` + datatype or @language + ``"`` + text. Results show the text only. An error in a filter is null, and the row goes.
Variables that may be unbound join by compatibility; all others by equality.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.graph import KnowledgeGraph
from kgloom.model import RDF_TYPE, XSD, GraphError
from kgloom.session import checkpoint, limited


class SparqlSyntaxError(GraphError):
    """The text is not a query of the supported subset."""


# ---------------------------------------------------------------- tokens

_TOKEN = re.compile(
    r"""(?P<skip>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<var>[?$][A-Za-z_]\w*)
    |(?P<string>\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<bnode>_:\w+)
    |(?P<name>[A-Za-z_][\w.-]*?:(?:[\w%-]|\.(?=[\w%-]))*|:(?:[\w%-]|\.(?=[\w%-]))*)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+\-*/|^?])""",
    re.X,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    at, out = 0, []
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlSyntaxError(f"unexpected {text[at : at + 12]!r} at {at}")
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, ("end", "", len(text))]


def _unescape(body: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


# ---------------------------------------------------------------- terms

INTEGER, DECIMAL, DOUBLE, BOOLEAN = (XSD + x for x in ("integer", "decimal", "double", "boolean"))


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Term:
    """kind: uri, literal or bnode."""

    kind: str
    text: str
    datatype: str | None = None
    lang: str | None = None

    @property
    def key(self) -> str:
        if self.kind != "literal":
            return self.text
        return '"' + (f"@{self.lang.lower()}" if self.lang else self.datatype or "") + '"' + self.text


def object_key() -> Column:
    """The key of the object of a triple row."""
    mark = F.coalesce(F.concat(F.lit("@"), F.lower("o_lang")), F.col("o_datatype"), F.lit(""))
    return F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), mark, F.lit('"'), F.col("o"))).otherwise(F.col("o"))


def is_literal(key: Column) -> Column:
    return key.startswith('"')


def text_of_key(key: Column) -> Column:
    """The text that a key shows."""
    return F.when(is_literal(key), _after_mark(key)).otherwise(key)


def _after_mark(key: Column) -> Column:
    rest = F.substring(key, 2, (1 << 31) - 1)
    return F.substr(rest, F.locate('"', rest) + 1)


def mark_of_key(key: Column) -> Column:
    return F.when(is_literal(key), F.substring_index(F.substring(key, 2, (1 << 31) - 1), '"', 1))


# ---------------------------------------------------------------- syntax tree


@dataclass
class Group:
    parts: list = field(default_factory=list)  # ("bgp", [...]) ("filter", e) ("optional", g) ("union", [g]) ("minus", g) ("values", vars, rows) ("bind", e, v) ("group", g) ("select", q)


@dataclass
class Query:
    form: str
    where: Group
    columns: list = field(default_factory=list)  # (expression, name); empty: *
    distinct: bool = False
    group_by: list = field(default_factory=list)
    having: list = field(default_factory=list)
    order_by: list = field(default_factory=list)  # (expression, descending)
    limit: int | None = None
    offset: int = 0


AGGREGATES = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}
REJECTED = {"GRAPH", "SERVICE", "CONSTRUCT", "DESCRIBE", "INSERT", "DELETE", "LOAD", "CLEAR", "DROP", "CREATE", "FROM"}


class Parser:
    def __init__(self, text: str, prefixes: dict[str, str] | None = None):
        self.tokens, self.at, self.fresh = _tokens(text), 0, 0
        self.prefixes, self.base = dict(prefixes or {}), ""

    # -- reading

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def value(self) -> str:
        return self.tokens[self.at][1]

    def fail(self, wanted: str):
        raise SparqlSyntaxError(f"expected {wanted}, found {self.value or 'the end'!r} at {self.tokens[self.at][2]}")

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def is_word(self, *words: str) -> bool:
        return self.kind == "word" and self.value.upper() in words

    def is_op(self, *ops: str) -> bool:
        return self.kind == "op" and self.value in ops

    def word(self, *words: str) -> bool:
        return self.is_word(*words) and bool(self.take())

    def op(self, *ops: str) -> bool:
        return self.is_op(*ops) and bool(self.take())

    def need(self, op: str) -> None:
        if not self.op(op):
            self.fail(repr(op))

    # -- query

    def query(self) -> Query:
        while self.is_word("PREFIX", "BASE"):
            if self.take().upper() == "BASE":
                self.base = self.take()[1:-1]
                continue
            name = self.take()
            if not name.endswith(":") or self.kind != "iri":
                self.fail("a prefix")
            self.prefixes[name[:-1]] = self.take()[1:-1]
        if self.is_word(*REJECTED):
            raise SparqlSyntaxError(f"{self.value.upper()} is not supported")
        found = self.select() if self.is_word("SELECT") else self.ask()
        if self.kind != "end":
            self.fail("the end")
        return found

    def ask(self) -> Query:
        if not self.word("ASK"):
            self.fail("SELECT or ASK")
        self.word("WHERE")
        query = Query("ask", self.group())
        self.modifiers(query)
        return query

    def select(self) -> Query:
        self.take()
        distinct = self.word("DISTINCT", "REDUCED")
        columns = []
        if not self.op("*"):
            while True:
                if self.kind == "var":
                    v = Var(self.take()[1:])
                    columns.append((v, v.name))
                elif self.op("("):
                    e = self.expression()
                    if not self.word("AS") or self.kind != "var":
                        self.fail("AS ?variable")
                    columns.append((e, self.take()[1:]))
                    self.need(")")
                elif self.is_word(*AGGREGATES):  # COUNT(?x) AS ?n without brackets
                    e = self.expression()
                    columns.append((e, self.take()[1:] if self.word("AS") else f"_{len(columns)}"))
                else:
                    break
            if not columns:
                self.fail("variables")
        if self.is_word(*REJECTED):
            raise SparqlSyntaxError(f"{self.value.upper()} is not supported")
        self.word("WHERE")
        query = Query("select", self.group(), columns, bool(distinct))
        self.modifiers(query)
        return query

    def modifiers(self, query: Query) -> None:
        if self.word("GROUP"):
            self.word("BY") or self.fail("BY")
            while self.kind == "var" or self.is_op("(") or self.is_word("STR", "LCASE", "YEAR"):
                if self.op("("):
                    e = self.expression()
                    name = self.take()[1:] if self.word("AS") else None
                    self.need(")")
                else:
                    e, name = self.primary(), None
                query.group_by.append((e, name or (e.name if isinstance(e, Var) else f"_g{len(query.group_by)}")))
        if self.word("HAVING"):
            while self.is_op("(") or self.is_word(*AGGREGATES):
                query.having.append(self.primary())
        if self.word("ORDER"):
            self.word("BY") or self.fail("BY")
            while True:
                if self.is_word("ASC", "DESC"):
                    down = self.take().upper() == "DESC"
                    query.order_by.append((self.primary(), down))
                elif self.kind == "var" or self.is_op("(") or self.is_word(*AGGREGATES, "STR", "LCASE", "YEAR"):
                    query.order_by.append((self.primary(), False))
                else:
                    break
        while self.is_word("LIMIT", "OFFSET"):
            which = self.take().upper()
            if self.kind != "number" or not self.value.isdigit():
                self.fail("a whole number")
            n = int(self.take())
            if which == "LIMIT":
                query.limit = n
            else:
                query.offset = n
        if self.is_word("VALUES"):
            query.where.parts.append(self.values())

    # -- patterns

    def group(self) -> Group:
        self.need("{")
        if self.is_word("SELECT"):
            inner = self.select()
            self.need("}")
            return Group([("select", inner)])
        found = Group()
        while not self.op("}"):
            if self.is_word(*REJECTED):
                raise SparqlSyntaxError(f"{self.value.upper()} is not supported")
            if self.op("."):
                continue
            if self.word("FILTER"):
                found.parts.append(("filter", self.constraint()))
            elif self.word("OPTIONAL"):
                found.parts.append(("optional", self.group()))
            elif self.word("MINUS"):
                found.parts.append(("minus", self.group()))
            elif self.is_word("VALUES"):
                found.parts.append(self.values())
            elif self.word("BIND"):
                self.need("(")
                e = self.expression()
                if not self.word("AS") or self.kind != "var":
                    self.fail("AS ?variable")
                found.parts.append(("bind", e, self.take()[1:]))
                self.need(")")
            elif self.is_op("{"):
                ways = [self.group()]
                while self.word("UNION"):
                    ways.append(self.group())
                found.parts.append(("union", ways) if len(ways) > 1 else ("group", ways[0]))
            else:
                triples = self.triples()
                if found.parts and found.parts[-1][0] == "bgp":
                    found.parts[-1][1].extend(triples)
                else:
                    found.parts.append(("bgp", triples))
        return found

    def constraint(self):
        if self.word("EXISTS"):
            return ("exists", self.group(), True)
        if self.is_word("NOT"):
            self.take()
            self.word("EXISTS") or self.fail("EXISTS")
            return ("exists", self.group(), False)
        return self.primary()

    def values(self):
        self.take()
        one = self.kind == "var"
        if one:
            names = [self.take()[1:]]
        else:
            self.need("(")
            names = []
            while self.kind == "var":
                names.append(self.take()[1:])
            self.need(")")
        self.need("{")
        rows = []
        while not self.op("}"):
            row = []
            if not one:
                self.need("(")
            while one and not row or not one and not self.is_op(")"):
                row.append(None if self.word("UNDEF") else self.term())
            if not one:
                self.need(")")
            if len(row) != len(names):
                self.fail("as many values as variables")
            rows.append(row)
        return ("values", names, rows)

    def triples(self) -> list:
        found: list = []
        subject = self.node(found)
        while True:
            if self.word("A"):
                verb = Term("uri", RDF_TYPE)
            elif self.kind == "var":
                verb = Var(self.take()[1:])
            elif self.is_op("^", "!", "("):
                raise SparqlSyntaxError("property paths are not supported")
            else:
                verb = self.term()
                if verb.kind != "uri":
                    self.fail("a predicate")
            if self.is_op("/", "|", "*", "+", "^", "?"):
                raise SparqlSyntaxError("property paths are not supported")
            while True:
                found.append((subject, verb, self.node(found)))
                if not self.op(","):
                    break
            while self.is_op(";"):
                self.take()
                more = not self.is_op(".", "}", ";") and self.kind != "end"
                if more:
                    break
            else:
                break
            if not more:
                break
        return found

    def node(self, found: list):
        if self.kind == "var":
            return Var(self.take()[1:])
        if self.kind == "bnode":
            return Var("_b" + self.take()[2:])
        if self.op("["):
            self.fresh += 1
            own = Var(f"_f{self.fresh}")
            if not self.op("]"):
                self.tokens.insert(self.at, ("var", f"?{own.name}", self.tokens[self.at][2]))
                found.extend(self.triples())
                self.need("]")
            return own
        return self.term()

    def term(self) -> Term:
        kind, value = self.kind, self.value
        if kind == "iri":
            self.take()
            iri = value[1:-1]
            return Term("uri", iri if ":" in iri else self.base + iri)
        if kind == "name":
            self.take()
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r}")
            return Term("uri", self.prefixes[prefix] + local)
        if kind == "string":
            self.take()
            body = _unescape(value[3:-3] if value[:3] in ('"""', "'''") and len(value) >= 6 else value[1:-1])
            if self.kind == "lang":
                return Term("literal", body, None, self.take()[1:])
            if self.op("^^"):
                kind = self.term().text
                return Term("literal", body, None if kind == XSD + "string" else kind)
            return Term("literal", body)
        if kind == "number" or self.is_op("+", "-") and self.tokens[self.at + 1][0] == "number":
            sign = self.take() if kind == "op" else ""
            number = self.take()
            return Term("literal", (sign if sign == "-" else "") + number, DOUBLE if "e" in number.lower() else DECIMAL if "." in number else INTEGER)
        if self.is_word("TRUE", "FALSE"):
            return Term("literal", self.take().lower(), BOOLEAN)
        return self.fail("a term")

    # -- expressions

    def expression(self):
        left = self.conjunction()
        while self.op("||"):
            left = ("call", "||", [left, self.conjunction()])
        return left

    def conjunction(self):
        left = self.comparison()
        while self.op("&&"):
            left = ("call", "&&", [left, self.comparison()])
        return left

    def comparison(self):
        left = self.sum()
        if self.is_op("=", "!=", "<", ">", "<=", ">="):
            return ("call", self.take(), [left, self.sum()])
        negated = False
        if self.is_word("NOT"):
            self.take()
            negated = True
            if not self.is_word("IN"):
                self.fail("IN")
        if self.word("IN"):
            self.need("(")
            items = []
            while not self.op(")"):
                items.append(self.expression())
                self.op(",")
            found = ("call", "IN", [left, *items])
            return ("call", "!", [found]) if negated else found
        return left

    def sum(self):
        left = self.product()
        while self.is_op("+", "-"):
            left = ("call", self.take(), [left, self.product()])
        return left

    def product(self):
        left = self.unary()
        while self.is_op("*", "/"):
            left = ("call", self.take(), [left, self.unary()])
        return left

    def unary(self):
        if self.op("!"):
            return ("call", "!", [self.unary()])
        if self.is_op("-") and self.tokens[self.at + 1][0] != "number":
            self.take()
            return ("call", "-", [Term("literal", "0", INTEGER), self.unary()])
        return self.primary()

    def primary(self):
        if self.op("("):
            e = self.expression()
            self.need(")")
            return e
        if self.kind == "var":
            return Var(self.take()[1:])
        if self.is_word("EXISTS", "NOT"):
            return self.constraint()
        if self.kind == "word" and not self.is_word("TRUE", "FALSE"):
            name = self.take().upper()
            self.need("(")
            return self.arguments(name)
        term = self.term()
        if term.kind == "uri" and self.op("("):
            return self.arguments(term.text)
        return term

    def arguments(self, name: str):
        distinct = name in AGGREGATES and self.word("DISTINCT")
        items, between = [], " "
        if self.op("*"):
            items.append("*")
        while not self.op(")"):
            if self.op(";"):
                self.word("SEPARATOR") or self.fail("SEPARATOR")
                self.need("=")
                between = self.term().text
                continue
            items.append(self.expression())
            if not self.op(",") and not self.is_op(")", ";"):
                self.fail("',' or ')'")
        if name in AGGREGATES:
            return ("aggregate", name, items, bool(distinct), between)
        return ("call", name, items)


def parse(text: str, prefixes: dict[str, str] | None = None) -> Query:
    return Parser(text, prefixes).query()


def check_syntax(text: str, prefixes: dict[str, str] | None = None) -> tuple[bool, str]:
    """(True, '') or (False, first line of the error)."""
    try:
        parse(text, prefixes)
    except SparqlSyntaxError as e:
        return False, str(e).split("\n")[0]
    return True, ""


# ---------------------------------------------------------------- expressions to columns


@dataclass
class Value:
    """A column and what it holds: a key of a term, a number, a string or a truth value."""

    column: Column
    kind: str

    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        if self.kind == "key":
            return F.when(is_literal(self.column), text_of_key(self.column)).try_cast("double")
        return self.column.try_cast("double")

    def string(self) -> Column:
        if self.kind == "key":
            return text_of_key(self.column)
        return _plain(self.column) if self.kind == "number" else self.column.cast("string")

    def truth(self) -> Column:
        if self.kind == "truth":
            return self.column
        if self.kind == "number":
            return self.column != 0
        text = self.string()
        mark = mark_of_key(self.column) if self.kind == "key" else F.lit("")
        return F.when(mark == BOOLEAN, text.isin("true", "1")).when(mark.isin(INTEGER, DECIMAL, DOUBLE), self.number() != 0).otherwise(F.length(text) > 0)

    def key(self) -> Column:
        if self.kind == "key":
            return self.column
        mark = {"number": F.when(self.column == F.floor(self.column), F.lit(INTEGER)).otherwise(F.lit(DOUBLE)) if self.kind == "number" else None, "truth": F.lit(BOOLEAN), "string": F.lit("")}[self.kind]
        return F.when(self.column.isNotNull(), F.concat(F.lit('"'), mark, F.lit('"'), self.string()))


def _plain(number: Column) -> Column:
    """Whole numbers without a point."""
    whole = number.cast("double")
    return F.when((whole == F.floor(whole)) & (F.abs(whole) < 1e15), whole.cast("long").cast("string")).otherwise(whole.cast("string"))


class Expressions:
    def __init__(self, now: date | None):
        self.now = now

    def of(self, e, names: set[str]) -> Value:
        if isinstance(e, Var):
            return Value(F.col(e.name) if e.name in names else F.lit(None).cast("string"), "key")
        if isinstance(e, Term):
            return Value(F.lit(e.key), "key")
        if isinstance(e, Value):
            return e
        if e[0] == "aggregate":
            raise SparqlSyntaxError("an aggregate is not allowed here")
        if e[0] == "exists":
            raise SparqlSyntaxError("EXISTS is only supported as a whole filter")
        _, name, items = e
        v = [self.of(x, names) for x in items]
        return self.call(name, items, v)

    def compare(self, op: str, a: Value, b: Value) -> Column:
        x, y = a.number(), b.number()
        act = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        if "number" in (a.kind, b.kind):
            return act(x, y)
        rest = act(a.key(), b.key()) if op in ("=", "!=") and a.kind == b.kind == "key" else act(a.string(), b.string())
        return F.when(x.isNotNull() & y.isNotNull(), act(x, y)).otherwise(rest)

    def call(self, name: str, items: list, v: list[Value]) -> Value:
        truth, string, number, key = ((lambda c, k=k: Value(c, k)) for k in ("truth", "string", "number", "key"))
        n = len(v)
        try:
            if name in ("||", "&&"):
                a, b = v[0].truth(), v[1].truth()
                return truth(a | b if name == "||" else a & b)
            if name == "!":
                return truth(~v[0].truth())
            if name in ("=", "!=", "<", ">", "<=", ">="):
                return truth(self.compare(name, *v))
            if name == "IN":
                found = F.lit(False)
                for other in v[1:]:
                    found = found | self.compare("=", v[0], other)
                return truth(found)
            if name in ("+", "-", "*"):
                a, b = v[0].number(), v[1].number()
                return number({"+": a + b, "-": a - b, "*": a * b}[name])
            if name == "/":
                return number(v[0].number() / F.nullif(v[1].number(), F.lit(0.0)))
            texts = [x.string() for x in v]
            if name == "CONTAINS":
                return truth(F.contains(texts[0], texts[1]))
            if name == "STRSTARTS":
                return truth(F.startswith(texts[0], texts[1]))
            if name == "STRENDS":
                return truth(F.endswith(texts[0], texts[1]))
            if name == "REGEX":
                if not isinstance(items[1], Term):
                    raise SparqlSyntaxError("REGEX needs a constant pattern")
                flags = items[2].text if n > 2 else ""
                return truth(texts[0].rlike((f"(?{flags})" if flags else "") + items[1].text))
            if name in ("LCASE", "UCASE", "STR", "STRLEN", "CONCAT", "REPLACE", "SUBSTR"):
                made = {"LCASE": lambda: F.lower(texts[0]), "UCASE": lambda: F.upper(texts[0]), "STR": lambda: texts[0], "STRLEN": lambda: F.length(texts[0]).cast("double"), "CONCAT": lambda: F.concat(*texts), "REPLACE": lambda: F.regexp_replace(texts[0], texts[1], texts[2]), "SUBSTR": lambda: F.substr(texts[0], v[1].number().cast("int"), *([v[2].number().cast("int")] if n > 2 else []))}[name]()
                return number(made) if name == "STRLEN" else string(made)
            if name == "BOUND":
                return truth(v[0].column.isNotNull())
            if name == "IF":
                if v[1].kind == v[2].kind:
                    return Value(F.when(v[0].truth(), v[1].column).otherwise(v[2].column), v[1].kind)
                return key(F.when(v[0].truth(), v[1].key()).otherwise(v[2].key()))
            if name == "COALESCE":
                return key(F.coalesce(*(x.key() for x in v)))
            if name == "NOW":
                return string(F.lit(self.now.isoformat()) if self.now else F.current_date().cast("string"))
            if name in ("YEAR", "MONTH", "DAY"):
                part = {"YEAR": r"^(-?\d{4,})", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)"}[name]
                return number(F.regexp_extract(texts[0], part, 1).try_cast("double"))
            if name in ("ABS", "FLOOR", "CEIL", "ROUND"):
                return number({"ABS": F.abs, "FLOOR": F.floor, "CEIL": F.ceil, "ROUND": F.round}[name](v[0].number()).cast("double"))
            if name == "LANG":
                mark = mark_of_key(v[0].key())
                return string(F.when(mark.startswith("@"), F.substring(mark, 2, 100)).when(mark.isNotNull(), ""))
            if name == "LANGMATCHES":
                return truth((F.lower(texts[0]) == F.lower(texts[1])) | F.startswith(F.lower(texts[0]), F.concat(F.lower(texts[1]), F.lit("-"))) | ((texts[1] == "*") & (texts[0] != "")))
            if name == "DATATYPE":
                mark = mark_of_key(v[0].key())
                return string(F.when(mark == "", XSD + "string").when(~mark.startswith("@"), mark))
            if name in ("ISIRI", "ISURI", "ISLITERAL", "ISBLANK"):
                k = v[0].key()
                return truth({"ISL": is_literal(k), "ISB": k.startswith("_:")}.get(name[:3], ~is_literal(k) & ~k.startswith("_:")))
            if name == "SAMETERM":
                return truth(v[0].key() == v[1].key())
            if name in ("IRI", "URI"):
                return key(texts[0])
            if name.startswith(XSD):
                kind = name[len(XSD) :]
                if kind == "string":
                    return string(texts[0])
                if kind == "boolean":
                    return truth(F.lower(texts[0]).try_cast("boolean"))
                if kind in ("integer", "int", "long"):
                    return number(F.floor(v[0].number()).cast("double"))
                return number(v[0].number()) if kind in ("decimal", "double", "float") else string(texts[0])
        except IndexError:
            raise SparqlSyntaxError(f"{name} has too few arguments") from None
        raise SparqlSyntaxError(f"function {name} is not supported")


# ---------------------------------------------------------------- patterns to DataFrames


@dataclass
class Solutions:
    """A DataFrame with a column for each variable; ``sure`` are those that are always bound."""

    df: DataFrame
    names: set[str]
    sure: set[str]


#: A column for keys of rows (no variable can have this name), and the parts of a side that rows which fit anything are sent to.
ROW, SPREAD = "§row", 32


class Compiler:
    def __init__(self, kg: KnowledgeGraph, now: date | None = None):
        self.kg, self.spark = kg, kg.triples.sparkSession
        self.say = Expressions(now)

    def unit(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), set(), set())

    def pattern(self, s, p, o) -> Solutions:
        rows, seen, columns = self.kg.triples, {}, []
        for part, item, column in (("s", s, F.col("s")), ("p", p, F.col("p")), ("o", o, object_key())):
            if isinstance(item, Term):
                if part != "o":
                    rows = rows.where(F.col(part) == item.text)
                elif item.kind != "literal":
                    rows = rows.where((F.col("o") == item.text) & (F.col("o_kind") != "literal"))
                else:
                    kind = F.col("o_datatype").isNull() if item.datatype is None else F.col("o_datatype") == item.datatype
                    lang = F.col("o_lang").isNull() if item.lang is None else F.lower("o_lang") == item.lang.lower()
                    rows = rows.where((F.col("o") == item.text) & (F.col("o_kind") == "literal") & kind & lang)
            elif item.name in seen:
                rows = rows.where(seen[item.name] == column)
            else:
                seen[item.name] = column
                columns.append(column.alias(item.name))
        return Solutions(rows.select(*columns), set(seen), set(seen))

    def bgp(self, patterns: list) -> Solutions:
        """Most constants first, then always one that shares a variable, so no Cartesian product while one is connected."""
        todo, found = list(patterns), None
        bound = lambda t: (2 * isinstance(t[0], Term) + 2 * (isinstance(t[2], Term)) + isinstance(t[1], Term))
        names = lambda t: {x.name for x in t if isinstance(x, Var)}
        while todo:
            shared = [t for t in todo if found is None or not names(t) or names(t) & found.names] or todo
            best = max(shared, key=lambda t: (bound(t), -todo.index(t)))
            todo.remove(best)
            new = self.pattern(*best)
            found = new if found is None else self.join(found, new)
        return found or self.unit()

    def join(self, a: Solutions, b: Solutions, how: str = "inner", conditions: list | tuple = (), common: bool = False) -> Solutions:
        """Joins on the shared variables that are bound on both sides; an unbound one fits anything.

        Where a shared variable may be unbound, each side is divided by which of them are, so that every pair of divisions
        is an equi-join. ``conditions`` are expressions over both sides that a match must pass; ``common`` asks for a
        shared variable that is bound on both sides (as MINUS does).
        """
        shared = sorted(a.names & b.names)
        firm = [v for v in shared if v in a.sure and v in b.sure]
        loose = [v for v in shared if v not in firm]
        right = b.df.select(*(F.col(v).alias(f"__{v}") for v in sorted(b.names))) if b.names else b.df.select(F.lit(1).alias("__one"))

        def bound(e):
            if isinstance(e, Var):
                own = [F.col(c) for c, there in ((e.name, e.name in a.names), (f"__{e.name}", e.name in b.names)) if there]
                return Value(F.coalesce(*own) if own else F.lit(None).cast("string"), "key")
            return ("call", e[1], [bound(x) for x in e[2]]) if isinstance(e, tuple) else e

        tests = [self.say.of(bound(e), set()).truth() for e in conditions]

        def divided(df: DataFrame, sure: set[str], mark: str) -> list[tuple[set, DataFrame]]:
            found = [(set(), df)]
            for v in loose:
                if v not in sure:
                    found = [x for free, d in found for x in ((free, d.where(F.col(mark + v).isNotNull())), (free | {v}, d.where(F.col(mark + v).isNull())))]
            return found

        lefts, rights = divided(a.df, a.sure, ""), divided(right, b.sure, "__")

        def one(left: DataFrame, other: DataFrame, free: set, way: str) -> DataFrame:
            keys = firm + [v for v in loose if v not in free]
            match = [F.col(v) == F.col(f"__{v}") for v in keys] + tests
            if match:
                whole = match[0]
                for x in match[1:]:
                    whole = whole & x
                return left.join(other, whole, way)
            if way != "inner":  # any row of the other side will do
                return left.join(other.limit(1).select(F.lit(1).alias("__any")), F.lit(True), way)
            if not free:
                return left.crossJoin(other)
            # Rows that fit anything are sent to all parts of the other side.
            spread = left.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
            dealt = other.withColumn("__at", F.pmod(F.xxhash64(*other.columns), F.lit(SPREAD)).cast("int"))
            return spread.join(dealt, F.col("__part") == F.col("__at")).drop("__part", "__at")

        def shown(df: DataFrame) -> DataFrame:
            columns = [F.coalesce(F.col(v), F.col(f"__{v}")).alias(v) if v in loose else F.col(v) for v in sorted(a.names)]
            return df.select(*columns, *(F.col(f"__{v}").alias(v) for v in sorted(b.names - a.names)))

        out: list[DataFrame] = []
        undivided = len(lefts) * len(rights) == 1
        for free, left in lefts:
            rest = left
            for other_free, other in rights:
                both = free | other_free
                if common and not firm and set(loose) <= both:
                    continue
                if how in ("inner", "left"):
                    out.append(shown(one(left, other, both, how if undivided else "inner")))
                elif how == "left_semi":
                    out.append(one(rest, other, both, "left_semi"))
                if how == "left_anti" or how != "inner" and not undivided:
                    rest = one(rest, other, both, "left_anti")
            if how == "left_anti":
                out.append(rest)
            elif how == "left" and not undivided:
                out.append(rest.select(*sorted(a.names), *(F.lit(None).cast("string").alias(v) for v in sorted(b.names - a.names))))
        joined = out[0]
        for more in out[1:]:
            joined = joined.unionByName(more)
        if how in ("left_semi", "left_anti"):
            return Solutions(joined, a.names, a.sure)
        return Solutions(joined, a.names | b.names, a.sure | (b.sure if how == "inner" else set()))

    def group(self, g: Group) -> Solutions:
        found, filters = None, []
        for part in g.parts:
            kind = part[0]
            if kind == "filter":
                filters.append(part[1])
                continue
            if kind == "bind":
                found = found or self.unit()
                found = Solutions(found.df.withColumn(part[2], self.say.of(part[1], found.names).key()), found.names | {part[2]}, found.sure)
                continue
            if kind == "optional":
                found = self.optional(found or self.unit(), part[1])
                continue
            if kind == "minus":
                found = self.minus(found or self.unit(), self.group(part[1]))
                continue
            new = {"bgp": self.bgp, "group": self.group, "union": self.union, "select": self.select}.get(kind, lambda _: self.values(*part[1:]))(part[1])
            found = new if found is None else self.join(found, new)
        found = found or self.unit()
        for e in filters:
            found = self.filter(found, e)
        return found

    def filter(self, found: Solutions, e) -> Solutions:
        if isinstance(e, tuple) and e[0] == "exists":
            return self.exists(found, e[1], e[2])
        if isinstance(e, tuple) and e[:2] == ("call", "!") and isinstance(e[2][0], tuple) and e[2][0][0] == "exists":
            return self.filter(found, ("exists", e[2][0][1], not e[2][0][2]))
        if isinstance(e, tuple) and e[:2] == ("call", "&&"):
            return self.filter(self.filter(found, e[2][0]), e[2][1])
        return Solutions(found.df.where(self.say.of(e, found.names).truth()), found.names, found.sure)

    def exists(self, found: Solutions, g: Group, wanted: bool) -> Solutions:
        """Rows for which the group has (or has no) match; its filters also see the row's variables."""
        plain = Group([p for p in g.parts if p[0] != "filter"])
        inner = self.group(plain)
        filters = [p[1] for p in g.parts if p[0] == "filter"]
        outer = [e for e in filters if (_names(e) - inner.names) & found.names]
        for e in filters:
            if e not in outer:
                inner = self.filter(inner, e)
        way = "left_semi" if wanted else "left_anti"
        if not any(_has_exists(e) for e in outer):
            return self.join(found, inner, way, outer)
        # A nested EXISTS that sees both: rows get a key that stays, since they are materialised with it.
        marked = Solutions(checkpoint(found.df.withColumn(ROW, F.monotonically_increasing_id().cast("string"))), found.names | {ROW}, found.sure | {ROW})
        joined = self.join(marked, inner)
        for e in outer:
            joined = self.filter(joined, e)
        return Solutions(marked.df.join(joined.df.select(ROW).distinct(), ROW, way).select(*sorted(found.names)), found.names, found.sure)

    def optional(self, found: Solutions, g: Group) -> Solutions:
        """A filter that sees both sides belongs to the join's condition."""
        own = [p[1] for p in g.parts if p[0] == "filter" and not _has_exists(p[1])]
        inner = self.group(Group([p for p in g.parts if p[0] != "filter" or p[1] not in own]))
        both = [e for e in own if _names(e) - inner.names]
        for e in own:
            if e not in both:
                inner = self.filter(inner, e)
        return self.join(found, inner, "left", both)

    def minus(self, a: Solutions, b: Solutions) -> Solutions:
        return self.join(a, b, "left_anti", common=True) if a.names & b.names else a

    def union(self, ways: list[Group]) -> Solutions:
        found = [self.group(w) for w in ways]
        names = set().union(*(f.names for f in found))
        df = found[0].df
        for f in found[1:]:
            df = df.unionByName(f.df, allowMissingColumns=True)
        return Solutions(df.select(*sorted(names)), names, set.intersection(*(f.sure for f in found)))

    def values(self, names: list[str], rows: list) -> Solutions:
        data = [tuple(t and t.key for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` string" for n in names))
        return Solutions(F.broadcast(df), set(names), {n for i, n in enumerate(names) if all(r[i] is not None for r in data)})

    # -- select

    def select(self, q: Query) -> Solutions:
        found = self.group(q.where)
        aggregates: list = []

        def lifted(e):
            """The expression with each aggregate replaced by a column."""
            if isinstance(e, tuple) and e[0] == "aggregate":
                if e not in aggregates:
                    aggregates.append(e)
                i = aggregates.index(e)
                return Value(F.col(f"__a{i}"), "number" if e[1] in ("COUNT", "SUM", "AVG") else "string" if e[1] == "GROUP_CONCAT" else "key")
            if isinstance(e, tuple) and e[0] == "call":
                return ("call", e[1], [lifted(x) for x in e[2]])
            return e

        columns = [(lifted(e), n) for e, n in q.columns]
        having = [lifted(e) for e in q.having]
        order = [(lifted(e), d) for e, d in q.order_by]
        if q.group_by or aggregates:
            if not q.columns:
                raise SparqlSyntaxError("SELECT * cannot be grouped")
            found = self.grouped(found, q.group_by, aggregates)
            for e in having:
                found = Solutions(found.df.where(self.say.of(e, found.names).truth()), found.names, found.sure)
        if not columns:
            columns = [(Var(n), n) for n in sorted(found.names) if not n.startswith("_")]
        made = {n: self.say.of(e, found.names) for e, n in columns if not isinstance(e, Var)}
        df, names = found.df, set(found.names)
        for n, value in made.items():
            df, names = df.withColumn(n, value.key()), names | {n}
        for _, n in columns:
            if n not in names:
                df = df.withColumn(n, F.lit(None).cast("string"))
        keys = [k for e, down in order for k in _order(self.say.of(e, names), down)]
        shown = [F.col(n) for _, n in columns]
        if q.distinct:
            held = df.select(*shown).distinct()
            if keys and all(_names(e) <= {n for _, n in columns} for e, _ in q.order_by):
                df = held.orderBy(*keys, *shown)
            else:
                df = held.orderBy(*shown) if q.limit is not None or q.offset else held
        else:
            if keys:
                df = df.orderBy(*keys, *shown)
            elif q.limit is not None or q.offset:
                df = df.orderBy(*shown)
            df = df.select(*shown)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        out = [n for _, n in columns]
        return Solutions(df, set(out), {n for e, n in columns if isinstance(e, Var) and e.name in found.sure})

    def grouped(self, found: Solutions, by: list, aggregates: list) -> Solutions:
        df, names = found.df, set(found.names)
        for e, n in by:
            if not isinstance(e, Var):
                df, names = df.withColumn(n, self.say.of(e, names).key()), names | {n}
        made = []
        for i, (_, name, items, distinct, between) in enumerate(aggregates):
            star = items == ["*"]
            v = None if star else self.say.of(items[0], names)
            if name == "COUNT":
                column = F.count(F.lit(1)) if star and not distinct else F.countDistinct(F.struct(*sorted(found.names)) if star else v.key()) if distinct else F.count(v.key())
            elif name in ("SUM", "AVG"):
                x = F.sum_distinct(v.number()) if distinct and name == "SUM" else F.sum(v.number()) if name == "SUM" else F.avg(v.number())
                column = F.coalesce(x, F.lit(0.0))
            elif name in ("MIN", "MAX"):
                act = F.min_by if name == "MIN" else F.max_by
                column = act(v.key(), F.struct(is_literal(v.key()), v.number(), v.string()))
            elif name == "SAMPLE":
                column = F.min(v.key())
            else:
                column = F.array_join(F.array_sort(F.collect_set(v.string()) if distinct else F.collect_list(v.string())), between)
            made.append(column.alias(f"__a{i}"))
        by_names = [n for _, n in by]
        df = df.groupBy(*by_names).agg(*made) if made else df.select(*by_names).distinct()
        return Solutions(df, set(by_names), {n for n in by_names if n in found.sure})


def _names(e) -> set[str]:
    """The variables of an expression, with those of the groups of its EXISTS."""
    if isinstance(e, Var):
        return {e.name}
    if isinstance(e, Group):
        return set().union(*(_names(p) for p in e.parts))
    if isinstance(e, (tuple, list)):
        return set().union(*(_names(x) for x in e))
    return set()


def _has_exists(e) -> bool:
    return isinstance(e, tuple) and (e[0] == "exists" or e[0] == "call" and any(_has_exists(x) for x in e[2]))


def _order(v: Value, down: bool) -> list[Column]:
    if v.kind == "number":
        return [v.column.desc() if down else v.column.asc()]
    k = v.key()
    keys = [F.when(k.isNull(), 0).when(k.startswith("_:"), 1).when(is_literal(k), 3).otherwise(2), v.number(), v.string()]
    return [c.desc() if down else c.asc() for c in keys]


def compile_sparql(text: str, kg: KnowledgeGraph, now: date | None = None, prefixes: dict[str, str] | None = None) -> DataFrame:
    """The result of a query: a string column for each variable, or one row ``boolean`` for ASK."""
    query = parse(text, prefixes)
    compiler = Compiler(kg, now)
    if query.form == "ask":
        return compiler.group(query.where).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("boolean"))
    found = compiler.select(query)
    names = [n for _, n in query.columns] or sorted(n for n in found.names if not n.startswith("_"))
    return found.df.select(*(text_of_key(F.col(n)).alias(n) for n in names))


def execute(text: str, kg: KnowledgeGraph, timeout: float | None = None, most: int = 1_000_000, **options) -> tuple[bool, list[dict], str | None]:
    """(success, rows, error): rows leave out unbound variables. Beyond ``timeout`` seconds the query's jobs are cancelled.

    A result of over ``most`` rows is an error, as it would not fit the caller: use compile_sparql, whose result stays distributed.
    """
    ok, rows, error = limited(kg.triples.sparkSession, lambda: compile_sparql(text, kg, **options).limit(most + 1).collect(), timeout)
    if ok and len(rows) > most:
        ok, error = False, f"the result has over {most} rows"
    return (True, [{k: v for k, v in r.asDict().items() if v is not None} for r in rows], None) if ok else (False, [], error)


def execute_or_empty(text: str, kg: KnowledgeGraph, timeout: float | None = None, **options) -> list[dict]:
    """Rows, or none if the query fails or takes too long."""
    return execute(text, kg, timeout, **options)[1]


def run_sparql(text: str, kg: KnowledgeGraph, **options) -> tuple[str, list[dict] | None, str | None]:
    """(status, rows, error) with status boolean, bindings or error."""
    ok, rows, error = execute(text, kg, **options)
    if not ok:
        return "error", None, error
    return ("boolean" if rows and set(rows[0]) == {"boolean"} and parse(text).form == "ask" else "bindings"), rows, None
