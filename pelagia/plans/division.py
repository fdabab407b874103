"""The dialect's `/`: between integers it truncates, between floats a zero divisor gives an infinity or NaN.

Spark's `/` does neither, and which one a text means depends on the operands' types. So the text is analysed (not run) with
every operand marked, the types are read off the analysed plan, and each `/` becomes `div`, a guarded division or stays.
Operands that hold a division themselves wait for the next round; a round is one analysis.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pelagia.plans.tokens import Token, closing, render, tokenize

_STOP = {
    "SELECT", "DISTINCT", "ALL", "FROM", "WHERE", "GROUP", "BY", "HAVING", "ORDER", "LIMIT", "OFFSET", "ON", "AND", "OR", "NOT", "IN", "LIKE", "BETWEEN",
    "IS", "THEN", "ELSE", "WHEN", "CASE", "AS", "VALUES", "SET", "RETURN", "QUALIFY", "USING", "ROWS", "RANGE", "PRECEDING", "FOLLOWING", "UNION", "INTERSECT",
    "EXCEPT", "RLIKE", "ILIKE", "SIMILAR", "NULLS", "ASC", "DESC", "EXCLUDE", "REPLACE", "WITHIN",
}
_LOOSER = {"+", "-", "=", "<", ">", "<=", ">=", "<>", "!=", "||", ",", ";", "=>", "->", "&", "|", "^", "("}
_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_FLOATS = ("float", "double")

_SOURCE = """
import java.util.*;
import org.apache.spark.sql.catalyst.expressions.*;
import org.apache.spark.sql.catalyst.plans.QueryPlan;
public class PelagiaTypes {
  public Map types(Object plan) { Map out = new HashMap(); plan(out, (QueryPlan) plan); return out; }
  void plan(Map out, QueryPlan p) {
    scala.collection.Iterator it = p.expressions().iterator();
    while (it.hasNext()) expression(out, (Expression) it.next());
    it = p.children().iterator();
    while (it.hasNext()) plan(out, (QueryPlan) it.next());
  }
  void expression(Map out, Expression e) {
    if (e instanceof ElementAt && ((ElementAt) e).left() instanceof CreateMap) {
      CreateMap m = (CreateMap) ((ElementAt) e).left();
      if (m.children().size() == 2) {
        String key = String.valueOf(m.children().apply(0));
        if (key.startsWith("#")) out.put(key, ((Expression) m.children().apply(1)).dataType().simpleString());
      }
    }
    if (e instanceof PlanExpression) plan(out, (QueryPlan) ((PlanExpression) e).plan());
    scala.collection.Iterator it = e.children().iterator();
    while (it.hasNext()) expression(out, (Expression) it.next());
  }
}
"""


def _left(tokens: list[Token], at: int) -> int:
    """Where the left operand of the division at `at` starts: the chain of * / % that ends there."""
    i = at - 1
    while i >= 0:
        t = tokens[i]
        if t.text in (")", "]"):
            depth = 0
            while i >= 0:
                depth += tokens[i].text in (")", "]")
                depth -= tokens[i].text in ("(", "[")
                if not depth:
                    break
                i -= 1
        elif t.up == "END":
            depth = 0
            while i >= 0:
                depth += tokens[i].up == "END"
                depth -= tokens[i].up == "CASE"
                if not depth:
                    break
                i -= 1
        elif t.text in _LOOSER or t.text == "[" or t.kind == "word" and t.up in _STOP and not (i + 1 < len(tokens) and tokens[i + 1].text == "." or i and tokens[i - 1].text == "."):
            return i + 1
        i -= 1
    return 0


def _right(tokens: list[Token], at: int) -> int:
    """Past the right operand of the division at `at`: one signed primary with what binds closer."""
    i = at + 1
    while i < len(tokens) and tokens[i].text in ("-", "+", "~"):
        i += 1
    if i >= len(tokens):
        return i
    if tokens[i].up == "CASE":
        depth = 0
        while i < len(tokens):
            depth += tokens[i].up == "CASE"
            depth -= tokens[i].up == "END"
            i += 1
            if not depth:
                break
    elif tokens[i].text == "(":
        i = closing(tokens, i) + 1
    elif tokens[i].text == ":":  # a parameter
        i += 2
    else:
        i += 1 + (tokens[i].up in ("DATE", "TIMESTAMP", "INTERVAL") and i + 1 < len(tokens) and tokens[i + 1].kind == "string")
    while i < len(tokens):
        t = tokens[i]
        if t.text in ("(", "["):
            i = closing(tokens, i) + 1
        elif t.text == ".":
            i += 2
        elif t.text == "::":
            i += 2
        elif t.up in ("OVER", "FILTER") and i + 1 < len(tokens):
            i = (closing(tokens, i + 1) if tokens[i + 1].text == "(" else i + 1) + 1
        else:
            break
    return i


def _open(tokens: list[Token]) -> list[tuple[int, int, int]]:
    """(start, division, end) of the divisions whose operands hold no other."""
    out = []
    for i, t in enumerate(tokens):
        if t.kind == "op" and t.text == "/":
            a, b = _left(tokens, i), _right(tokens, i)
            if not any(x.kind == "op" and x.text == "/" for x in (*tokens[a:i], *tokens[i + 1 : b])):
                out.append((a, i, b))
    return out


def _zero_free(tokens: list[Token]) -> bool:
    if len(tokens) != 1 or tokens[0].kind != "number":
        return False
    try:
        return float(tokens[0].text.rstrip("DdLl")) != 0
    except ValueError:
        return False


def _types(spark: SparkSession, df: DataFrame) -> dict[str, str]:
    reader = getattr(spark, "_pelagia_types", None)
    if reader is None:
        jvm = spark.sparkContext._jvm
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(_SOURCE)
        gateway = spark.sparkContext._gateway
        made = compiler.getClassLoader().loadClass("PelagiaTypes").getDeclaredConstructor(gateway.new_array(jvm.java.lang.Class, 0))
        reader = spark._pelagia_types = made.newInstance(gateway.new_array(jvm.java.lang.Object, 0))
    return dict(reader.types(df._jdf.queryExecution().analyzed()))


def divisions(sql: str, spark: SparkSession, analyse: Callable[[str], DataFrame]) -> str:
    """sql with every `/` in the dialect's sense. A text that cannot be analysed stays, and fails where it is run."""
    tokens = tokenize(sql)
    if not any(t.kind == "op" and t.text == "/" for t in tokens):
        return sql
    while found := _open(tokens):
        names: dict[str, int] = {}
        number = [names.setdefault(render(tokens[a:b]), len(names)) for a, _, b in found]  # equal texts must stay equal
        marked: list[Token] = []
        at = 0
        for k, (a, i, b) in zip(number, found):
            marked += [*tokens[at:a], *_marked(f"#{k}a", tokens[a:i]), Token("done", "/"), *_marked(f"#{k}b", tokens[i + 1 : b])]
            at = b
        marked += tokens[at:]
        try:
            types = _types(spark, analyse(render(marked)))
        except Exception:  # the caller runs the text as it is and meets the error there
            return sql
        out: list[Token] = []
        at = 0
        for k, (a, i, b) in zip(number, found):
            out += [*tokens[at:a], *_divided(tokens[a:i], tokens[i + 1 : b], types.get(f"#{k}a", ""), types.get(f"#{k}b", ""))]
            at = b
        tokens = out + tokens[at:]
    return render(tokens)


def _marked(key: str, operand: list[Token]) -> list[Token]:
    return [*tokenize(f"element_at(map('{key}', "), *operand, *tokenize(f"), '{key}')")]


def _divided(a: list[Token], b: list[Token], left: str, right: str) -> list[Token]:
    if left in _INTEGERS and right in _INTEGERS:
        kind = max(left, right, key=_INTEGERS.index)
        return [*tokenize("CAST(("), *a, *tokenize(") div ("), *b, *tokenize(f") AS {kind})")]
    if (left in _FLOATS or right in _FLOATS) and not _zero_free(b):
        return [*tokenize("float_divide("), *a, Token("op", ","), *b, Token("op", ")")]
    return [*tokenize("(("), *a, *tokenize(") "), Token("done", "/"), *b, Token("op", ")")]
