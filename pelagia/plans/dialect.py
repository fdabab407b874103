"""Rewrites of the query dialect into Spark SQL.

Handled: clustering over windows, double-quoted names, `* EXCLUDE (..)`, `* REPLACE (..)`, list literals, trailing commas, QUALIFY,
SELECT DISTINCT ON, $n parameters, try_arrow_cast, UNION [ALL] BY NAME, GROUPS frames, and table functions
read_x(..) / x_schema(..), which become temporary views (the front end resolves them, so that Catalyst sees plain
scans and can prune and push down).
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import DataFrame

from pelagia.plans.tokens import Token, closing, find_top, name_of, render, split_top, string_of, tokenize
from pelagia.types import arrow_to_spark

W = lambda s: Token("word", s)
O = lambda s: Token("op", s)  # noqa: E731, E741
_CLAUSES = ("FROM", "WHERE", "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", "WINDOW")


def literal(tokens: list[Token]) -> object:
    """A literal argument of a table function: string, number, boolean, NULL, or a list of them."""
    if len(tokens) == 1:
        t = tokens[0]
        if t.kind == "string":
            return string_of(t)
        if t.kind == "number":
            return ast.literal_eval(t.text)
        if t.up in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.up]
    if tokens and tokens[0].text == "[" and tokens[-1].text == "]":
        return [literal(p) for p in split_top(tokens[1:-1]) if p]
    if len(tokens) > 2 and tokens[0].up in ("ARRAY", "MAKE_ARRAY") and tokens[1].text in ("(", "["):
        return [literal(p) for p in split_top(tokens[2:-1]) if p]
    if len(tokens) == 2 and tokens[0].text == "-":
        return -literal(tokens[1:])
    raise ValueError(f"a table function takes literals, not {render(tokens)}")


def simple(tokens: list[Token]) -> list[Token]:
    """Local rewrites that need no knowledge of the query's shape."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        after = tokens[i + 1] if i + 1 < len(tokens) else None
        if t.text == "," and (after is None or after.text in (")", "]", ";") or after.up in _CLAUSES):
            i += 1
            continue
        if t.text == "[" and not (out and (out[-1].kind in ("word", "quoted") and out[-1].up not in _OPENERS or out[-1].text in (")", "]"))):
            j = closing(tokens, i)
            out += [W("array"), O("("), *simple(tokens[i + 1 : j]), O(")")]
            i = j + 1
            continue
        if t.text == "*" and after is not None and after.up == "EXCLUDE":
            if tokens[i + 2].text == "(":
                j = closing(tokens, i + 2)
                out += [t, W("EXCEPT"), *tokens[i + 2 : j + 1]]
            else:
                j = i + 2
                out += [t, W("EXCEPT"), O("("), tokens[j], O(")")]
            i = j + 1
            continue
        if t.text == "*" and after is not None and after.up == "REPLACE":
            j = closing(tokens, i + 2)
            parts = split_top(simple(tokens[i + 3 : j]))
            names = [p[-1] for p in parts]
            out += [t, W("EXCEPT"), O("(")]
            for k, n in enumerate(names):
                out += [O(",")] * (k > 0) + [n]
            out.append(O(")"))
            for p in parts:
                out += [O(","), *p]
            i = j + 1
            continue
        if t.up == "TRY_ARROW_CAST" and after is not None and after.text == "(":
            j = closing(tokens, i + 1)
            args = split_top(tokens[i + 2 : j])
            if len(args) != 2 or len(args[1]) != 1 or args[1][0].kind != "string" or not string_of(args[1][0]):
                raise ValueError("try_arrow_cast: the second argument must be a non-empty string literal")
            out += [W("try_cast"), O("("), *simple(args[0]), W("AS"), W(arrow_to_spark(string_of(args[1][0]))), O(")")]
            i = j + 1
            continue
        if t.kind == "word" and t.up in _TYPES and (out and out[-1].up in ("AS", "::")) and (after is None or after.text != "("):
            out.append(W(_TYPES[t.up]))
            i += 1
            continue
        if t.kind == "number" and not t.text[-1].isalpha() and not t.text.isdigit():  # a literal with a point is a float
            out.append(Token("number", t.text + "D"))
            i += 1
            continue
        if t.kind == "param":
            out.append(O(f":p{t.text[1:]}"))
            i += 1
            continue
        out.append(t)
        i += 1
    return out


_TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "VARBINARY": "BINARY", "BYTEA": "BINARY", "REAL": "FLOAT"}
_OPENERS = {"SELECT", "WHERE", "AND", "OR", "NOT", "IN", "THEN", "ELSE", "WHEN", "BY", "ON", "VALUES", "HAVING", "DISTINCT", "BETWEEN", "LIKE", "RETURN", "ALL"}


def shape(tokens: list[Token]) -> list[Token]:
    """Rewrites of whole SELECTs, innermost first: QUALIFY, DISTINCT ON, GROUPS frames."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        if tokens[i].text == "(":
            j = closing(tokens, i)
            out += [tokens[i], *shape(tokens[i + 1 : j]), tokens[j]]
            i = j + 1
        else:
            out.append(tokens[i])
            i += 1
    k = find_top(out, "UNION", "INTERSECT", "EXCEPT")
    while k > 0 and out[k].up == "EXCEPT" and out[k - 1].text == "*":
        k = find_top(out, "UNION", "INTERSECT", "EXCEPT", start=k + 1)
    if k > 0:
        n = k + 1 + (k + 1 < len(out) and out[k + 1].up in ("ALL", "DISTINCT"))
        return [*_select(out[:k]), *out[k:n], *shape(out[n:])]
    return _select(out)


def _select(q: list[Token]) -> list[Token]:
    start = find_top(q, "SELECT")
    if start < 0:
        return q
    head, q = q[:start], q[start:]
    q = _groups_frames(q)
    if len(q) > 2 and q[1].up == "DISTINCT" and q[2].up == "ON" and q[3].text == "(":
        j = closing(q, 3)
        keys = q[4:j]
        f, o = find_top(q, "FROM"), find_top(q, "ORDER")
        lim = find_top(q, "LIMIT", "OFFSET")
        stop = min(x for x in (o, lim, len(q)) if x >= 0)
        order = q[o + 2 : lim if lim > 0 else len(q)] if o > 0 else keys
        inner = [W("SELECT"), *q[j + 1 : f], O(","), W("row_number"), O("("), O(")"), W("OVER"), O("("), W("PARTITION"), W("BY"), *keys, W("ORDER"), W("BY"), *order, O(")"), W("AS"), W("__rank"), *q[f:stop]]
        tail = q[lim:] if lim > 0 else []
        q = [W("SELECT"), O("*"), W("EXCEPT"), O("("), W("__rank"), O(")"), W("FROM"), O("("), *inner, O(")"), W("WHERE"), W("__rank"), O("="), Token("number", "1"), *tail]
    k = find_top(q, "QUALIFY")
    if k > 0:
        f = find_top(q, "FROM")
        stop = find_top(q, "ORDER", "LIMIT", "OFFSET", start=k + 1)
        cond, tail = q[k + 1 : stop if stop > 0 else len(q)], q[stop:] if stop > 0 else []
        inner = [*q[:f], O(","), O("("), *cond, O(")"), W("AS"), W("__qualify"), *q[f:k]]
        q = [W("SELECT"), O("*"), W("EXCEPT"), O("("), W("__qualify"), O(")"), W("FROM"), O("("), *inner, O(")"), W("WHERE"), W("__qualify"), *tail]
    return head + q


def _groups_frames(q: list[Token]) -> list[Token]:
    """GROUPS frames: the source gets the dense rank of the window's order, and the frame becomes RANGE over it."""
    f = find_top(q, "FROM")
    if f < 0:
        return q
    ranks: list[list[Token]] = []
    out: list[Token] = []
    i = 0
    while i < len(q):
        if q[i].up == "OVER" and i + 1 < len(q) and q[i + 1].text == "(":
            j = closing(q, i + 1)
            inside = q[i + 2 : j]
            g = find_top(inside, "GROUPS")
            if g >= 0:
                o = find_top(inside, "ORDER")
                if o < 0:
                    raise ValueError("a GROUPS frame needs ORDER BY")
                name = W(f"__group{len(ranks)}")
                ranks.append([W("dense_rank"), O("("), O(")"), W("OVER"), O("("), *inside[:g], O(")"), W("AS"), name])
                out += [q[i], O("("), *inside[:o], W("ORDER"), W("BY"), name, W("RANGE"), *inside[g + 1 :], O(")")]
                i = j + 1
                continue
        out.append(q[i])
        i += 1
    if not ranks:
        return q
    f = find_top(out, "FROM")
    stop = find_top(out, "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", start=f)
    stop = stop if stop > 0 else len(out)
    extra = [t for r in ranks for t in (O(","), *r)]
    return [*out[: f + 1], O("("), W("SELECT"), O("*"), *extra, *out[f:stop], O(")"), *out[stop:]]


class Rewriter:
    """resolve(name, args, referenced) gives the DataFrame of a table function, or None if there is no such function;
    referenced lists the column names the query mentions, None for all of them."""

    def __init__(self, run: Callable[[str], DataFrame], resolve, register: Callable[[DataFrame], str], by_name, cluster=None):
        """cluster(function, source query with __geom and __part0.. added, arguments, partition columns, new column) gives
        the source with the clusters."""
        self.run, self.resolve, self.register, self.by_name, self.cluster = run, resolve, register, by_name, cluster
        self.clustered = 0

    def __call__(self, sql: str) -> str:
        tokens = tokenize(sql)
        while tokens and tokens[-1].text == ";":
            tokens.pop()
        return render(self.tokens(tokens))

    def tokens(self, tokens: list[Token]) -> list[Token]:
        tokens = self._clusters(tokens)
        return shape(simple(self._by_name(self._functions(tokens, _referenced(tokens)))))

    def _clusters(self, tokens: list[Token]) -> list[Token]:
        """Spatial clustering over windows: the source of the SELECT is clustered first and becomes a view."""
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            if tokens[i].text == "(" and i + 1 < len(tokens) and tokens[i + 1].up in ("SELECT", "FROM", "WITH"):
                j = closing(tokens, i)
                out += [tokens[i], *self._clusters(tokens[i + 1 : j]), tokens[j]]
                i = j + 1
            else:
                out.append(tokens[i])
                i += 1
        while True:
            at = next((i for i, t in enumerate(out[:-1]) if t.up in ("ST_CLUSTERKMEANS", "ST_CLUSTERDBSCAN") and out[i + 1].text == "("), -1)
            if at < 0:
                return out
            out = self._cluster(out, at)

    def _cluster(self, q: list[Token], at: int) -> list[Token]:
        a = closing(q, at + 1)
        if a + 2 >= len(q) or q[a + 1].up != "OVER" or q[a + 2].text != "(":
            raise ValueError(f"{q[at].text} is a window function: OVER (..) is missing")
        b = closing(q, a + 2)
        over = q[a + 3 : b]
        if over and (over[0].up != "PARTITION" or find_top(over, "ORDER", "ROWS", "RANGE", "GROUPS") >= 0):
            raise ValueError(f"{q[at].text} takes PARTITION BY only")
        by = split_top(over[2:]) if over else []
        geom, *args = split_top(q[at + 2 : a])
        start = -1
        while 0 <= (k := find_top(q, "SELECT", start=start + 1)) < at:
            start = k
        f = find_top(q, "FROM", start=start + 1)
        if start < 0 or f < 0:
            raise ValueError(f"{q[at].text} needs a SELECT list and FROM")
        stop = find_top(q, "GROUP", "HAVING", "QUALIFY", "ORDER", "LIMIT", "OFFSET", "UNION", "INTERSECT", "EXCEPT", start=f + 1)
        stop = stop if stop > 0 else len(q)
        if stop < len(q) and q[stop].up in ("GROUP", "HAVING"):
            raise ValueError(f"{q[at].text} and GROUP BY: put the groups in a subquery")
        name = W(f"__cluster{self.clustered}")
        self.clustered += 1
        head = q[: find_top(q, "SELECT")] if q[0].up == "WITH" else []
        inner = [*head, W("SELECT"), O("*"), O(","), *geom, W("AS"), W("__geom")]
        for k, part in enumerate(by):
            inner += [O(","), *part, W("AS"), W(f"__part{k}")]
        source = q[f:stop]
        df = self.cluster(q[at].text.lower(), render([*inner, *source]), [literal(x) for x in args], len(by), name.text)
        relation = source[1 : (w if (w := find_top(source, "WHERE")) > 0 else len(source))]
        single = find_top(relation, "JOIN") < 0 and len(split_top(relation)) == 1 and relation[-1].kind in ("word", "quoted")
        alias = [W("AS"), relation[-1]] if single else []
        items: list[Token] = []
        depth = 0
        for i in range(start + 1, f):
            t = q[i]
            depth += (t.text in ("(", "[")) - (t.text in (")", "]"))
            if at <= i <= b:
                items += [name] * (i == at)
                continue
            items.append(t)
            if t.text == "*" and not depth and (q[i - 1].up == "SELECT" or q[i - 1].text in (",", ".")) and q[i + 1].up not in ("EXCLUDE", "EXCEPT", "REPLACE"):
                items += [W("EXCEPT"), O("("), name, O(")")]
        return [*q[: start + 1], *items, W("FROM"), W(self.register(df)), *alias, *q[stop:]]

    def _functions(self, tokens: list[Token], referenced: list[str] | None) -> list[Token]:
        out: list[Token] = []
        bounds = ranges(tokens)
        i = 0
        while i < len(tokens):
            t = tokens[i]
            opens = i + 1 < len(tokens) and tokens[i + 1].text == "("
            before = out[-1].up if out else ""
            if t.kind == "word" and opens and before in ("FROM", "JOIN", ","):
                j = closing(tokens, i + 1)
                inside = tokens[i + 2 : j]
                if self.resolve.knows(t.text):
                    args = [literal(p) for p in split_top(inside) if p]
                    out.append(W(self.register(self.resolve(t.text, args, referenced, bounds))))
                    i = j + 1
                    continue
            if bounds and before == "FROM" and not opens and t.kind in ("word", "quoted"):
                pruned = self.resolve.table(name_of(t), bounds)
                if pruned is not None:
                    out.append(W(self.register(pruned)))
                    if i + 1 == len(tokens) or tokens[i + 1].up in _CLAUSES or tokens[i + 1].text in (")", ";") or tokens[i + 1].up == "WHERE":
                        out += [W("AS"), t]
                    i += 1
                    continue
            if t.text == "(" and i + 1 < len(tokens) and tokens[i + 1].up in ("SELECT", "FROM", "WITH"):
                j = closing(tokens, i)
                inside = tokens[i + 1 : j]
                out += [t, *self._functions(inside, _referenced(inside)), tokens[j]]
                i = j + 1
                continue
            out.append(t)
            i += 1
        return out

    def _by_name(self, tokens: list[Token]) -> list[Token]:
        out: list[Token] = []
        i = 0
        while i < len(tokens):
            if tokens[i].text == "(":
                j = closing(tokens, i)
                out += [tokens[i], *self._by_name(tokens[i + 1 : j]), tokens[j]]
                i = j + 1
            else:
                out.append(tokens[i])
                i += 1
        parts: list[tuple[bool, list[Token]]] = []
        rest, every = out, True
        start = 0
        while True:
            k = find_top(rest, "UNION", start=start)
            if k < 0:
                break
            n = k + 1 + (rest[k + 1].up == "ALL")
            if not (rest[n].up == "BY" and rest[n + 1].up == "NAME"):
                start = k + 1
                continue
            parts.append((every, rest[:k]))
            every = rest[k + 1].up == "ALL"
            rest, start = rest[n + 2 :], 0
        if not parts:
            return out
        stop = find_top(rest, "ORDER", "LIMIT", "OFFSET")
        tail, last = (rest[stop:], rest[:stop]) if stop > 0 else ([], rest)
        parts.append((every, last))
        frame = None
        for keep, part in parts:
            df = self.run(render(shape(simple(part))))
            frame = df if frame is None else self.by_name(frame, df)
            frame = frame if keep else frame.distinct()
        return [W("SELECT"), O("*"), W("FROM"), W(self.register(frame)), *tail]


def ranges(tokens: list[Token]) -> dict[str, tuple[float | None, float | None]]:
    """The ranges of numeric columns that WHERE demands of a SELECT over one relation: conjuncts `column op number` and
    `column BETWEEN a AND b`; anything else says nothing. Empty for joins and set operations."""
    w, f = find_top(tokens, "WHERE"), find_top(tokens, "FROM")
    if w < 0 or f < 0 or find_top(tokens, "JOIN", "UNION", "INTERSECT", "EXCEPT", "LATERAL") >= 0 or len(split_top(tokens[f + 1 : w])) != 1:
        return {}
    stop = find_top(tokens, "GROUP", "HAVING", "QUALIFY", "WINDOW", "ORDER", "LIMIT", "OFFSET", start=w + 1)
    where = tokens[w + 1 : stop if stop > 0 else len(tokens)]
    if find_top(where, "OR") >= 0:
        return {}
    out: dict[str, tuple[float | None, float | None]] = {}

    def number(part: list[Token]) -> float | None:
        sign = -1 if part and part[0].text == "-" else 1
        part = part[1:] if sign < 0 else part
        return sign * float(part[0].text.rstrip("DdLl")) if len(part) == 1 and part[0].kind == "number" else None

    def narrow(name: str, low: float | None, high: float | None) -> None:
        a, b = out.get(name, (None, None))
        out[name] = (max((x for x in (a, low) if x is not None), default=None), min((x for x in (b, high) if x is not None), default=None))

    conjuncts: list[list[Token]] = [[]]
    depth, between = 0, False
    for t in where:
        depth += t.text in ("(", "[")
        depth -= t.text in (")", "]")
        between |= t.up == "BETWEEN" and not depth
        if t.up == "AND" and not depth and not between:
            conjuncts.append([])
        else:
            between &= not (t.up == "AND" and not depth)
            conjuncts[-1].append(t)
    for c in conjuncts:
        if len(c) > 2 and c[1].text == ".":
            c = c[2:]
        if len(c) < 3 or c[0].kind not in ("word", "quoted"):
            continue
        name = name_of(c[0])
        if c[1].up == "BETWEEN":
            k = find_top(c, "AND")
            low, high = number(c[2:k]), number(c[k + 1 :])
            if k > 0 and low is not None and high is not None:
                narrow(name, low, high)
        elif (value := number(c[2:])) is not None:
            if c[1].text in (">", ">=", "="):
                narrow(name, value, None)
            if c[1].text in ("<", "<=", "="):
                narrow(name, None, value)
    return out


def _referenced(tokens: list[Token]) -> list[str] | None:
    """Names that a query mentions; None if it selects `*` (a count(*) mentions nothing by itself)."""
    names = []
    for i, t in enumerate(tokens):
        if t.text == "*":
            before = tokens[i - 1] if i else None
            if before is not None and (before.up in ("SELECT", "DISTINCT", "ALL", ",") or before.text == "."):
                return None
        if t.kind in ("word", "quoted") and (t.kind == "quoted" or t.up not in _CLAUSES):
            names.append(name_of(t))
    return names
