"""Function names and table names in rewritten SQL."""

from __future__ import annotations

from pelagia.functions.scalar import RENAMED, java_pattern, parse_pattern
from pelagia.functions.spatial_spec import BY_ARITY
from pelagia.plans.tokens import Token, closing, find_top, name_of, render, split_top, string_of, tokenize

W = lambda s: Token("word", s)
_COLLECTED = "st_geomfromtext(concat('GEOMETRYCOLLECTION (', array_join(sort_array(collect_list(st_astext($))), ', '), ')'))"
#: Spatial aggregates, in terms of builtin ones.
_AGGREGATES = {
    "st_extent": "named_struct('xmin', min(st_xmin($)), 'ymin', min(st_ymin($)), 'xmax', max(st_xmax($)), 'ymax', max(st_ymax($)))",
    "st_collect": _COLLECTED,
    "st_memunion": f"st_unionall({_COLLECTED})",
}


def _flagged(pattern: str, flags: list[Token] | None) -> str:
    """A pattern with its flags in front (g, every occurrence, says nothing here)."""
    if not flags:
        return pattern
    if len(flags) == 1 and flags[0].kind == "string":
        inline = "".join(f for f in string_of(flags[0]) if f != "g")
        return f"concat('(?{inline})', {pattern})" if inline else pattern
    if len(flags) == 1 and flags[0].up == "NULL":
        return pattern
    raise ValueError("regular expressions: flags must be a string literal")


def _literal(part: list[Token], what: str) -> str:
    if len(part) != 1 or part[0].kind != "string":
        raise ValueError(f"{what} must be a string literal")
    return string_of(part[0])


_INTEGERS = "('tinyint', 'smallint', 'int', 'bigint')"


def _parsed(e: str, formats: list[list[Token]], kind: str) -> str:
    """The first format that fits; the last one raises if none does."""
    patterns = ["'" + parse_pattern(_literal(f, "a format")).replace("'", "''") + "'" for f in formats]
    tried = [f"CAST(try_to_timestamp({e}, {p}) AS {kind})" for p in patterns]
    return f"coalesce({', '.join([*tried, f'CAST(to_timestamp({e}, {patterns[-1]}) AS {kind})'])})"


def _stamp(unit: str, e: str, formats: list[list[Token]]) -> str:
    """to_timestamp and its kin: an integer counts units since the epoch, a text is parsed and cut to the unit."""
    kept = {"seconds": "SECOND", "millis": "MILLISECOND"}.get(unit)
    text = _parsed(e, formats, "TIMESTAMP_NTZ") if formats else f"CAST(CAST({e} AS STRING) AS TIMESTAMP_NTZ)"
    if kept:
        text = f"CAST(date_trunc('{kept}', {text}) AS TIMESTAMP_NTZ)"
    if formats:
        return text
    count = f"to_timestamp_{unit or 'seconds'}(try_cast(CAST({e} AS STRING) AS BIGINT))"
    return f"CASE WHEN typeof({e}) IN {_INTEGERS} THEN {count} ELSE {text} END"


#: Parts of a date or time that Spark numbers in its own way.
_PARTS = {
    "dow": "(dayofweek($) - 1)",
    "isodow": "weekday($)",
    "epoch": "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST($ AS TIMESTAMP_NTZ)) / CAST(1000000 AS DOUBLE))",
    "second": "CAST(floor(extract(SECOND FROM $)) AS INT)",
    "millisecond": "CAST(floor(extract(SECOND FROM $) * 1000) AS INT)",
    "microsecond": "CAST(floor(extract(SECOND FROM $) * 1000000) AS INT)",
    "nanosecond": "CAST(extract(SECOND FROM $) * 1000000000 AS BIGINT)",
}


def _part(part: str, e: str) -> str:
    part = part.lower()
    part = part if part in ("dow", "isodow", "epoch") else part.removesuffix("s")
    return _PARTS[part].replace("$", e) if part in _PARTS else f"date_part('{part}', {e})"


def _rewritten(name: str, inside: list[Token], sub) -> tuple[str, bool] | None:
    """A call in Spark's terms, and whether it needs the JVM functions; None: as it is. sub rewrites an argument."""
    parts = [p for p in split_top(inside) if p]
    n = len(parts)
    a = [sub(p) for p in parts]
    if name in ("trim", "ltrim", "rtrim") and n == 2 and find_top(inside, "FROM") < 0:
        side = {"trim": "BOTH", "ltrim": "LEADING", "rtrim": "TRAILING"}[name]
        return f"trim({side} {a[1]} FROM {a[0]})", False
    if name in ("date_part", "datepart") and n == 2:
        return _part(_literal(parts[0], f"{name}: the part"), a[1]), False
    if name == "extract" and find_top(inside, "FROM") == 1:
        word = inside[0]
        return _part(string_of(word) if word.kind == "string" else word.text, sub(inside[2:])), False
    if name == "to_date" and n > 1:
        return _parsed(a[0], parts[1:], "DATE"), False
    if name == "to_time" and n > 1:
        patterns = ["'" + parse_pattern(_literal(f, "a format")).replace("'", "''") + "'" for f in parts[1:]]
        return f"coalesce({', '.join([*(f'try_to_time({a[0]}, {p})' for p in patterns), f'to_time({a[0]}, {patterns[-1]})'])})", False
    if name == "to_timestamp" or name.startswith("to_timestamp_") and name[13:] in ("seconds", "millis", "micros", "nanos"):
        return _stamp(name[13:], a[0], parts[1:]), False
    if name == "from_unixtime":
        return f"from_unixtime_zone({a[0]}, {a[1]})" if n == 2 else f"from_unixtime_seconds({a[0]})", False
    if name == "chr" and n == 1:
        return f"chr_of({a[0]})", True
    if name == "regexp_like" and n == 3:
        return f"regexp_like({a[0]}, {_flagged(a[1], parts[2])})", False
    if name == "regexp_match":
        return f"regexp_match_of({a[0]}, {_flagged(a[1], parts[2] if n > 2 else None)})", True
    if name == "regexp_count" and n > 2:
        return f"regexp_count_of({a[0]}, {_flagged(a[1], parts[3] if n > 3 else None)}, {a[2]})", True
    if name == "regexp_instr" and n > 2:
        return f"regexp_instr_of({a[0]}, {_flagged(a[1], parts[4] if n > 4 else None)}, {a[2]}, {a[3] if n > 3 else '1'}, {a[5] if n > 5 else '0'})", True
    if name == "log":
        return f"log_of({a[0]}, {a[1]})" if n == 2 else f"log10_of({a[0]})", False
    return None


def nulls(tokens: list[Token]) -> list[Token]:
    """ORDER BY with its default placement of nulls written out: last when ascending, first when descending."""
    out: list[Token] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.up == "ORDER" and i + 1 < len(tokens) and tokens[i + 1].up == "BY":
            out += tokens[i : i + 2]
            i += 2
            item: list[Token] = []
            depth = 0
            while True:
                t = tokens[i] if i < len(tokens) else None
                ends = t is None or not depth and (t.text in (")", "]", ";") or t.up in _AFTER_ORDER)
                if ends or not depth and t.text == ",":
                    words = [x.up for x in item]
                    if item and "NULLS" not in words and not (len(item) == 1 and words[0] == "ALL"):
                        item += [W("NULLS"), W("FIRST" if words[-1] == "DESC" else "LAST")]
                    out += nulls(item)
                    item = []
                    if ends:
                        break
                    out.append(t)
                else:
                    depth += t.text in ("(", "[")
                    depth -= t.text in (")", "]")
                    item.append(t)
                i += 1
            continue
        out.append(t)
        i += 1
    return out


_AFTER_ORDER = {"LIMIT", "OFFSET", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "SORT", "CLUSTER", "DISTRIBUTE", "FETCH"}


def functions(sql: str, use_spatial, spark=None) -> str:
    tokens = tokenize(sql)
    out: list[Token] = []
    spatial = False
    i = 0
    while i < len(tokens):
        t = tokens[i]
        call = t.kind == "word" and i + 1 < len(tokens) and tokens[i + 1].text == "(" and not (out and out[-1].text == ".")
        low = t.text.lower() if call else ""
        if call and low in _REWRITTEN:
            j = closing(tokens, i + 1)
            done = _rewritten(low, tokens[i + 2 : j], lambda p: functions(render(p), use_spatial, spark))
            if done:
                out += tokenize(done[0])
                spatial |= done[1]
                i = j + 1
                continue
        if call and low in _AGGREGATES:
            spatial = True
            j = closing(tokens, i + 1)
            g = functions(render(tokens[i + 2 : j]), use_spatial, spark)
            out += tokenize(_AGGREGATES[low].replace("$", g))
            i = j + 1
            continue
        if call and low == "coalesce_label":
            j = closing(tokens, i + 1)
            parts = [p for p in split_top(tokens[i + 2 : j]) if p]
            labels = parts[1::2]
            if len(parts) % 2 or not parts or any(len(x) != 1 or x[0].kind != "string" for x in labels):
                raise ValueError("coalesce_label: pairs of a column and a string literal are needed")
            cases = "".join(f" WHEN {functions(render(c), use_spatial, spark)} IS NOT NULL THEN {x[0].text}" for c, x in reversed(list(zip(parts[::2], labels))))
            out += tokenize(f"CASE{cases} END")
            i = j + 1
            continue
        if call and low.startswith("st_"):
            spatial = True
            j = closing(tokens, i + 1)
            n = len([a for a in split_top(tokens[i + 2 : j]) if a])
            out.append(W(BY_ARITY.get((low, n), low)))
            i += 1
            continue
        if call and low == "concat":
            out += [W("concat_ws"), tokens[i + 1], Token("string", "''"), Token("op", ",")]
            i += 2
            continue
        if call and low in ("to_char", "date_format"):
            j = closing(tokens, i + 1)
            parts = split_top(tokens[i + 2 : j])
            if len(parts) == 2 and len(parts[1]) == 1 and parts[1][0].kind == "string":
                pattern = java_pattern(string_of(parts[1][0])).replace("'", "''")
                out += [W("date_format"), Token("op", "("), *tokenize(functions(render(parts[0]), use_spatial)), Token("op", ","), Token("string", f"'{pattern}'"), Token("op", ")")]
                i = j + 1
                continue
        if call and low == "regexp_replace":
            j = closing(tokens, i + 1)
            parts = split_top(tokens[i + 2 : j])
            flags = string_of(parts[3][0]) if len(parts) == 4 else ""
            pattern = parts[1]
            if "i" in flags:
                pattern = [W("concat_ws"), Token("op", "("), Token("string", "''"), Token("op", ","), Token("string", "'(?i)'"), Token("op", ","), *pattern, Token("op", ")")]
            out += [W("regexp_replace" if "g" in flags else "regexp_replace_first"), Token("op", "("), *parts[0], Token("op", ","), *pattern, Token("op", ","), *parts[2], Token("op", ")")]
            i = j + 1
            continue
        if call and low in ("approx_percentile_cont", "percentile_cont") and not (low == "percentile_cont" and _within(tokens, i)):
            out.append(W("percentile"))
            i += 1
            continue
        if call and low in RENAMED:
            out.append(W(RENAMED[low]))
            i += 1
            continue
        out.append(t)
        i += 1
    if spatial:
        use_spatial()
        if spark is not None and not getattr(spark, "_pelagia_within", False):
            spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION st_within_point(w STRING, x DOUBLE, y DOUBLE) RETURNS BOOLEAN RETURN coalesce(st_contains(w, st_point(x, y)), false)")
            spark._pelagia_within = True
    return render(nulls(out))


_REWRITTEN = {
    "trim", "ltrim", "rtrim", "date_part", "datepart", "extract", "to_date", "to_time", "to_timestamp", "to_timestamp_seconds", "to_timestamp_millis",
    "to_timestamp_micros", "to_timestamp_nanos", "from_unixtime", "chr", "regexp_like", "regexp_match", "regexp_count", "regexp_instr", "log",
}


def _system(tokens: list[Token], con) -> list[Token]:
    """information_schema.x and system.x become views of this query."""
    from pelagia.system import TABLES

    out: list[Token] = []
    i = 0
    while i < len(tokens):
        key = (tokens[i].text.lower(), name_of(tokens[i + 2]).lower()) if i + 2 < len(tokens) and tokens[i + 1].text == "." else None
        if key in TABLES and out and out[-1].up in ("FROM", "JOIN", ","):
            out.append(W(con._view(TABLES[key](con))))
            i += 3
            continue
        out.append(tokens[i])
        i += 1
    return out


def _within(tokens: list[Token], i: int) -> bool:
    j = closing(tokens, i + 1)
    return j + 1 < len(tokens) and tokens[j + 1].up == "WITHIN"


def tables(sql: str, con) -> str:
    """Catalog views, and external tables whose rows depend on the columns, become temporary views of this query."""
    tokens = tokenize(sql)
    mentioned = [name_of(t) for t in tokens if t.kind in ("word", "quoted")]
    star = any(t.text == "*" and i and (tokens[i - 1].up in ("SELECT", ",") or tokens[i - 1].text == ".") for i, t in enumerate(tokens))
    tokens = _system(tokens, con)
    out: list[Token] = []
    for i, t in enumerate(tokens):
        name = name_of(t) if t.kind in ("word", "quoted") else ""
        e = con.catalog.entries.get(name)
        after_from = out and out[-1].up in ("FROM", "JOIN", ",")
        is_call = i + 1 < len(tokens) and tokens[i + 1].text == "("
        if e and after_from and not is_call and (e["kind"] == "view" or e["kind"] == "external" and e["format"] in ("netcdf", "hdf5", "zarr", "tiff", "geotiff", "odv", "postgres", "mysql")):
            view = con._view(con.catalog.table(name, None if star else mentioned))
            out.append(W(view))
            nxt = tokens[i + 1] if i + 1 < len(tokens) else None
            if nxt is None or nxt.up not in ("AS",) and not (nxt.kind in ("quoted",) or nxt.kind == "word" and nxt.up not in _KEYWORDS):
                out += [W("AS"), Token("quoted", f"`{name}`")]
            continue
        out.append(t)
    return render(out)


_KEYWORDS = {"WHERE", "GROUP", "ORDER", "HAVING", "LIMIT", "OFFSET", "JOIN", "LEFT", "RIGHT", "FULL", "INNER", "CROSS", "NATURAL", "ON", "USING", "UNION", "INTERSECT", "EXCEPT", "WINDOW", "SEMI", "ANTI", "LATERAL", "TABLESAMPLE", "SELECT"}
