"""Statements that Spark has no words for, or that act on the engine's own catalog. Anything else is a query."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pelagia import crawler, presets, stats
from pelagia.catalog import CatalogError, sql_type
from pelagia.operators.summarize import summarize
from pelagia.plans.tokens import Token, find_top, name_of, render, split_top, string_of, tokenize
from pelagia.sources import sinks


def _rows(con, rows: list, schema: str) -> DataFrame:
    return con.spark.createDataFrame(rows, schema)


def _done(con) -> DataFrame:
    return _rows(con, [], "ok boolean")


class Words:
    """Reads a statement word by word."""

    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k].up if self.i + k < len(self.t) else ""

    def take(self, *words: str) -> bool:
        if [self.peek(k) for k in range(len(words))] == list(words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise CatalogError(f"expected {' '.join(words)} at {self.peek() or 'the end'}")

    def name(self) -> str:
        out = name_of(self.t[self.i])
        self.i += 1
        while self.peek() == "." and self.i + 1 < len(self.t):
            out = name_of(self.t[self.i + 1])
            self.i += 2
        return out

    def string(self) -> str:
        t = self.t[self.i]
        if t.kind != "string":
            raise CatalogError(f"expected a string at {t.text}")
        self.i += 1
        return string_of(t)

    def brackets(self) -> list[Token]:
        from pelagia.plans.tokens import closing

        if self.peek() != "(":
            raise CatalogError(f"expected ( at {self.peek() or 'the end'}")
        j = closing(self.t, self.i)
        out = self.t[self.i + 1 : j]
        self.i = j + 1
        return out

    def rest(self) -> list[Token]:
        return self.t[self.i :]


def _options(w: Words) -> dict[str, str]:
    out = {}
    for part in split_top(w.brackets()):
        part = [t for t in part if t.text != "="]
        if len(part) >= 2:
            key = "".join(string_of(t) if t.kind == "string" else name_of(t) for t in part[:-1])
            out[key.removeprefix("format.")] = string_of(part[-1]) if part[-1].kind == "string" else part[-1].text
    return out


def _need(con, privilege: str, table: str) -> None:
    if con.user is not None:
        con.authority.check_table(con.user, table, privilege)


def _admin(con) -> None:
    if con.user is not None and not con.authority.state["users"].get(con.user, {}).get("admin"):
        from pelagia.auth import AccessError

        raise AccessError(f"{con.user} is no administrator")


def statement(con, sql: str) -> DataFrame | None:
    """Runs a statement; None if the text is a query for Spark."""
    tokens = tokenize(sql)
    while tokens and tokens[-1].text == ";":
        tokens.pop()
    w = Words(tokens)
    fn = _HEADS.get(w.peek())
    return fn(con, w) if fn else None


def _create(con, w: Words) -> DataFrame | None:
    w.need("CREATE")
    replace = w.take("OR", "REPLACE")
    if w.take("EXTERNAL", "TABLE"):
        maybe = w.take("IF", "NOT", "EXISTS")
        name = w.name()
        _need(con, "CREATE", name)
        if w.peek() == "(":
            w.brackets()
        entry: dict = {"kind": "external", "partitions": [], "options": {}}
        while w.peek():
            if w.take("STORED", "AS"):
                entry["format"] = w.name().lower()
            elif w.take("LOCATION"):
                entry["location"] = con.paths(w.string())
            elif w.take("PARTITIONED", "BY"):
                entry["partitions"] = [name_of(p[0]) for p in split_top(w.brackets())]
            elif w.take("OPTIONS"):
                entry["options"] = _options(w)
            elif w.take("WITH", "HEADER", "ROW"):
                pass
            else:
                raise CatalogError(f"CREATE EXTERNAL TABLE: unexpected {w.peek()}")
        if "format" not in entry or "location" not in entry:
            raise CatalogError("CREATE EXTERNAL TABLE needs STORED AS and LOCATION")
        con.catalog.define(name, entry, replace, maybe)
        return _done(con)
    if w.take("TABLE"):
        maybe = w.take("IF", "NOT", "EXISTS")
        name = w.name()
        _need(con, "CREATE", name)
        if w.peek() == "(":
            fields = []
            for p in split_top(w.brackets()):
                words = [t.up for t in p]
                if words[0] in ("PRIMARY", "CONSTRAINT", "UNIQUE"):
                    continue
                stop = next((k for k in range(1, len(p)) if p[k].up in ("NOT", "NULL", "DEFAULT", "PRIMARY")), len(p))
                fields.append(T.StructField(name_of(p[0]), sql_type(render(p[1:stop])), True))
            con.catalog.create_managed(name, T.StructType(fields), None, replace, maybe)
            return _done(con)
        w.need("AS")
        if maybe and name in con.catalog.entries:
            return _done(con)
        df = con.sql(render(w.rest())).df
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        con.catalog.create_managed(name, schema, df, replace, maybe)
        return _done(con)
    if w.take("MATERIALIZED", "VIEW"):
        maybe = w.take("IF", "NOT", "EXISTS")
        name = w.name()
        _need(con, "CREATE", name)
        w.need("AS")
        con.catalog.create_materialized(name, render(w.rest()), replace, maybe)
        return _done(con)
    if w.take("VIEW"):
        name = w.name()
        _need(con, "CREATE", name)
        w.need("AS")
        con.catalog.create_view(name, render(w.rest()), replace)
        return _done(con)
    if w.take("INDEX"):
        name = None if w.peek() == "ON" else w.name()
        w.need("ON")
        table = w.name()
        kind = w.name().lower() if w.take("USING") else "btree"
        columns = [name_of(p[0]) for p in split_top(w.brackets())]
        if w.take("USING"):
            kind = w.name().lower()
        if kind not in ("btree", "bitmap", "inverted"):
            raise CatalogError(f"unknown index type {kind}")
        e = con.catalog._managed(table)
        e["indexes"].append({"name": name or f"{table}_{'_'.join(columns)}_idx", "columns": columns, "type": kind})
        con.catalog._save()
        if kind == "btree":  # what an index gives a scan of Parquet: row groups with narrow ranges
            con.catalog.replace(table, con.catalog.table(table).repartitionByRange(*columns).sortWithinPartitions(*columns))
        return _done(con)
    if w.take("CRAWLER"):
        _admin(con)
        maybe = w.take("IF", "NOT", "EXISTS")
        name = w.name()
        conf: dict = {}
        while w.peek():
            if w.take("ON") or w.take("LOCATION") or w.take("FOR"):
                conf["path"] = w.string()
            elif w.take("PREFIX"):
                conf["prefix"] = w.string()
            elif w.take("SCHEDULE") or w.take("EVERY"):
                conf["schedule"] = w.string()
            elif w.take("OPTIONS") or w.take("WITH"):
                conf |= _options(w)
            else:
                raise CatalogError(f"CREATE CRAWLER: unexpected {w.peek()}")
        if "path" not in conf:
            raise CatalogError("CREATE CRAWLER needs a folder")
        key = f"__crawler_{name}"
        if key in con.catalog.entries and not (replace or maybe):
            raise CatalogError(f"crawler {name} already exists")
        con.catalog.entries.setdefault(key, {"kind": "crawler", "name": name, "conf": conf}) if maybe else con.catalog.entries.update({key: {"kind": "crawler", "name": name, "conf": conf}})
        con.catalog._save()
        return _done(con)
    if w.take("USER"):
        _admin(con)
        name = w.name()
        password = w.string() if w.take("WITH", "PASSWORD") or w.take("PASSWORD") or w.take("IDENTIFIED", "BY") else None
        con.authority.create_user(name, password)
        return _done(con)
    if w.take("ROLE"):
        _admin(con)
        con.authority.create_role(w.name())
        return _done(con)
    if w.take("SECRET"):
        _admin(con)
        name = w.name()
        con.catalog.entries[f"__secret_{name}"] = {"kind": "secret", "name": name, "keys": sorted(_options(w))}
        con.catalog._save()
        return _done(con)
    return None


def _drop(con, w: Words) -> DataFrame | None:
    w.need("DROP")
    kind = w.peek()
    if kind in ("TABLE", "VIEW", "MATERIALIZED"):
        w.take("MATERIALIZED")
        w.i += 1
        maybe = w.take("IF", "EXISTS")
        name = w.name()
        _need(con, "DROP", name)
        con.catalog.drop(name, maybe)
        return _done(con)
    if w.take("INDEX"):
        name = w.name()
        table = w.name() if w.take("ON") else None
        for n, e in con.catalog.entries.items():
            if e.get("indexes") and table in (None, n):
                e["indexes"] = [x for x in e["indexes"] if x["name"] != name]
        con.catalog._save()
        return _done(con)
    if w.take("CRAWLER") or w.take("SECRET"):
        _admin(con)
        w.take("IF", "EXISTS")
        con.catalog.entries.pop(f"__{kind.lower()}_{w.name()}", None)
        con.catalog._save()
        return _done(con)
    if w.take("EXTENSION"):
        return _extension(con, w, None)
    if w.take("USER"):
        _admin(con)
        con.authority.drop_user(w.name())
        return _done(con)
    if w.take("ROLE"):
        _admin(con)
        con.authority.drop_role(w.name())
        return _done(con)
    return None


def _insert(con, w: Words) -> DataFrame | None:
    w.need("INSERT", "INTO")
    name = w.name()
    if name not in con.catalog.entries:
        return None
    _need(con, "INSERT", name)
    columns = [name_of(p[0]) for p in split_top(w.brackets())] if w.peek() == "(" else None
    count = con.catalog.insert(name, con._plain(con.rewrite(render(w.rest()))), columns)
    return _rows(con, [(count,)], "count long")


def _delete(con, w: Words) -> DataFrame:
    w.need("DELETE", "FROM")
    name = w.name()
    _need(con, "DELETE", name)
    con.catalog.delete(name, con.rewrite(render(w.rest())) if w.take("WHERE") else None)
    return _done(con)


def _update(con, w: Words) -> DataFrame:
    w.need("UPDATE")
    name = w.name()
    _need(con, "UPDATE", name)
    w.need("SET")
    rest = w.rest()
    if find_top(rest, "FROM") >= 0:
        raise CatalogError("UPDATE takes no FROM")
    k = find_top(rest, "WHERE")
    changes = {name_of(p[0]): con.rewrite(render(p[2:])) for p in split_top(rest if k < 0 else rest[:k])}
    con.catalog.update(name, changes, None if k < 0 else con.rewrite(render(rest[k + 1 :])))
    return _done(con)


def _alter(con, w: Words) -> DataFrame:
    w.need("ALTER", "TABLE")
    name = w.name()
    _need(con, "ALTER", name)
    if w.take("ADD"):
        w.take("COLUMN")
        column = w.name()
        con.catalog.alter(name, "add", column, render(w.rest()))
    elif w.take("DROP"):
        w.take("COLUMN")
        con.catalog.alter(name, "drop", w.name())
    elif w.take("RENAME"):
        w.take("COLUMN")
        column = w.name()
        w.need("TO")
        con.catalog.alter(name, "rename", column, w.name())
    else:
        w.need("ALTER")
        w.take("COLUMN")
        column = w.name()
        w.take("SET", "DATA")
        w.need("TYPE")
        con.catalog.alter(name, "type", column, render(w.rest()))
    return _done(con)


def _refresh(con, w: Words) -> DataFrame:
    w.need("REFRESH")
    w.take("MATERIALIZED", "VIEW")
    con.catalog.refresh(w.name())
    return _done(con)


def _summarize(con, w: Words) -> DataFrame:
    w.need("SUMMARIZE")
    rest = w.rest()
    if len(rest) == 1 and name_of(rest[0]) in con.catalog.entries:
        return summarize(con.table(name_of(rest[0])).df)
    text = render(rest)
    return summarize(con.sql(text if find_top(rest, "SELECT") >= 0 else f"SELECT * FROM {text}").df)


def _analyze(con, w: Words) -> DataFrame | None:
    w.need("ANALYZE")
    if not w.take("FILES"):
        return None
    prefix = w.string() if w.i < len(w.t) and w.t[w.i].kind == "string" else None
    return stats.analyze(con, prefix, w.take("FORCE"))


def _copy(con, w: Words) -> DataFrame:
    w.need("COPY")
    df = con.sql(render(w.brackets())).df if w.peek() == "(" else con.table(w.name()).df
    w.need("TO")
    path = w.string()
    fmt = w.name().lower() if w.take("STORED", "AS") else path.rsplit(".", 1)[-1].lower()
    options = _options(w) if w.take("OPTIONS") else {}
    count = df.count()
    sinks.write(df, path, {"nc": "netcdf"}.get(fmt, fmt), **options)
    return _rows(con, [(count,)], "count long")


def _run(con, w: Words) -> DataFrame:
    w.need("RUN", "CRAWLER")
    _admin(con)
    name = w.name()
    e = con.catalog.get(f"__crawler_{name}")
    return crawler.run(con, name, e["conf"])


def _show(con, w: Words) -> DataFrame | None:
    w.need("SHOW")
    entries = con.catalog.entries
    if w.take("TABLES"):
        rows = [(n, {"external": "external", "managed": "managed", "view": "view", "mview": "materialized view"}[e["kind"]]) for n, e in sorted(entries.items()) if not n.startswith("__")]
        return _rows(con, rows, "table_name string, table_type string")
    if w.take("CRAWLERS"):
        return _rows(con, [(e["name"], e["conf"]["path"], e["conf"].get("schedule")) for e in entries.values() if e["kind"] == "crawler"], "name string, path string, schedule string")
    if w.take("SECRETS"):
        return _rows(con, [(e["name"], e["keys"]) for e in entries.values() if e["kind"] == "secret"], "name string, keys array<string>")
    if w.take("INDEXES") or w.take("INDEX"):
        table = w.name() if w.take("ON") or w.take("FROM") else None
        rows = [(n, x["name"], x["columns"], x["type"]) for n, e in entries.items() for x in e.get("indexes", []) if table in (None, n)]
        return _rows(con, rows, "table_name string, index_name string, columns array<string>, type string")
    if w.take("EXTENSION") or w.take("EXTENSIONS"):
        rows = [(n, json.dumps(e["preset"])) for n, e in sorted(entries.items()) if e.get("preset")]
        return _rows(con, rows, "table_name string, preset string")
    if w.take("COLUMNS"):
        w.take("FROM") or w.take("IN")
        return _describe_table(con, w.name())
    if w.take("USERS"):
        _admin(con)
        return _rows(con, [(n, u["roles"], u["admin"]) for n, u in sorted(con.authority.state["users"].items())], "user_name string, roles array<string>, is_admin boolean")
    if w.take("ROLES"):
        _admin(con)
        return _rows(con, [(n, [" ".join(x) for x in r["rules"]]) for n, r in sorted(con.authority.state["roles"].items())], "role_name string, rules array<string>")
    return None


def _describe_table(con, name: str) -> DataFrame:
    from pelagia.sources.readers import schema_table

    return schema_table(con.spark, con.table(name).df)


def _describe(con, w: Words) -> DataFrame | None:
    w.i += 1
    w.take("TABLE")
    if w.peek() in ("FUNCTION", "QUERY", "SELECT"):
        return None
    return _describe_table(con, w.name())


def _extension(con, w: Words, value: bool | None = True) -> DataFrame:
    """SET EXTENSION preset ON table '{json}' and DROP EXTENSION preset ON table."""
    kind = w.name().lower()
    w.need("ON")
    table = w.name()
    e = con.catalog.get(table)
    if value is None:
        e.pop(kind, None)
    else:
        w.take("AS") or w.take("TO")
        body = json.loads(w.string())
        e[kind] = presets.check(body) if kind == "preset" else body
    con.catalog._save()
    return _done(con)


def _set(con, w: Words) -> DataFrame | None:
    w.need("SET")
    if w.take("EXTENSION"):
        return _extension(con, w)
    m = re.fullmatch(r"([\w.]+)\s*(?:=|TO)\s*(.+)", " ".join(t.text for t in w.rest()).replace(" . ", "."))
    if not m:
        return None
    con.spark.conf.set(m[1], m[2].strip("'"))
    return _done(con)


def _privileges(con, w: Words) -> DataFrame:
    verb = w.name().upper()
    _admin(con)
    if w.take("ROLE"):
        role = w.name()
        w.need("TO") if verb == "GRANT" else w.need("FROM")
        (con.authority.grant_role if verb == "GRANT" else con.authority.revoke_role)(role, w.name())
        return _done(con)
    names = [w.name().upper()]
    while w.take(","):
        names.append(w.name().upper())
    w.need("ON")
    kind = "PATH" if w.take("PATH") else "TABLE"
    w.take("TABLE")
    target = w.string() if w.t[w.i].kind == "string" else w.name()
    w.need("FROM") if verb == "REVOKE" else w.need("TO")
    w.take("ROLE")
    role = w.name()
    for n in names:
        con.authority.rule(verb, n, kind, target, role)
    return _done(con)


def _explain(con, w: Words) -> DataFrame:
    w.need("EXPLAIN")
    measured = w.take("ANALYZE")
    w.take("VERBOSE")
    r = con.sql(render(w.rest()))
    if measured:
        import time

        began = time.time()
        n = r.df.count()
        return _rows(con, [("Plan with Metrics", f"rows: {n}, seconds: {time.time() - began:.3f}\n{r.explain()}")], "plan_type string, plan string")
    return _rows(con, [("logical_plan", r.explain("extended")), ("physical_plan", r.explain("formatted"))], "plan_type string, plan string")


_HEADS = {
    "CREATE": _create, "DROP": _drop, "INSERT": _insert, "DELETE": _delete, "UPDATE": _update, "ALTER": _alter, "REFRESH": _refresh,
    "SUMMARIZE": _summarize, "ANALYZE": _analyze, "COPY": _copy, "RUN": _run, "SHOW": _show, "DESCRIBE": _describe, "DESC": _describe,
    "SET": _set, "GRANT": _privileges, "REVOKE": _privileges, "DENY": _privileges, "EXPLAIN": _explain,
}
