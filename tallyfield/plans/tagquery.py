"""A small query language over tables of tagged observations.

`conjunct, conjunct, ... : field[element][slice]`. Conjuncts are expressions over columns; each sees the rows that the
earlier ones left, so `t > mean(t)` depends on its place. `@name` keeps ids that a list holds, `~@name` drops them,
`@@name` returns the list as it is, `/all` switches the stored default conjuncts off. A known id stands for
`id == 'that id'`. Rows are sorted by the field (ties: id) and sliced like a list; where neither is asked for, nothing is sorted.

Expressions are parsed with Python's grammar and translated node by node into Columns; anything outside the whitelist
is an error and nothing is evaluated. Only conjuncts with an aggregate start a new stage; others fuse into one filter.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import numbered as in_order
from ..lineage import placed

SCALARS: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "log10": F.log10, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "arcsin": F.asin, "arccos": F.acos, "arctan2": F.atan2, "floor": F.floor, "ceil": F.ceil, "round": F.round,
    "minimum": F.least, "maximum": F.greatest, "isnan": F.isnan, "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "isfinite": lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")),
}
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": F.median, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop}
_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: F.try_divide(a, b),
    ast.Mod: lambda a, b: F.pmod(a, b), ast.Pow: F.pow, ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b,
}
_COMPARE = {
    ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b,
}


class QueryError(ValueError):
    """The query is not in the language."""


def split_outside(text: str, sep: str) -> list[str]:
    """Splits at sep where it stands outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(text[start:k])
            start = k + 1
    return [*out, text[start:]]


@dataclass
class TagTable:
    """A table with an id column, and what a query may use besides its columns."""

    df: DataFrame
    id: str = "id"
    sort: str | None = None
    default: str = ""
    lists: dict[str, DataFrame] = field(default_factory=dict)
    functions: dict[str, Callable[..., Column]] = field(default_factory=dict)
    functors: dict[str, Callable[[DataFrame], Callable[..., Column]]] = field(default_factory=dict)

    def query(self, text: str = "", places: bool = False) -> DataFrame:
        """The selected rows. A slice comes with column `_pos`, the rows' places in the order; so does any query with places=True,
        which numbers rows in the default order, or those of a list as they stand. Without them a query is a plan of filters and
        semi joins, plus a sort where it names a field: nothing is run or written while it is made."""
        head, *tail = split_outside(text or "", ":")
        conjuncts, use_default, wanted = [], True, None
        for c in split_outside(head, ","):
            c = c.strip().lstrip("+")
            if c.startswith("/"):
                if c != "/all":
                    raise QueryError(f"unknown flag {c}")
                use_default = False
            elif c.startswith("@@"):
                wanted = c[2:]
            elif c:
                conjuncts.append(c)
        if wanted is not None:
            return placed(self._list(wanted), "_pos") if places else self._list(wanted)
        if use_default:
            conjuncts += [c for c in split_outside(self.default, ",") if c.strip()]
        df = self.df
        for c in conjuncts:
            df = self._restrict(df, c.strip())
        return self._ordered(df, ":".join(tail), places)

    def _list(self, name: str) -> DataFrame:
        if name not in self.lists:
            raise QueryError(f"unknown list {name}")
        return self.lists[name]

    def _restrict(self, df: DataFrame, c: str) -> DataFrame:
        if c.startswith("@") or c.startswith("~@"):
            ids = self._list(c.lstrip("~@")).select(F.col(self.id)).distinct()
            return df.join(ids, self.id, "left_anti" if c[0] == "~" else "left_semi")
        return self._filter(df, c)

    def _filter(self, df: DataFrame, c: str) -> DataFrame:
        try:
            tree = ast.parse(c.strip(), mode="eval").body
        except SyntaxError as e:
            raise QueryError(f"cannot parse {c!r}") from e
        found: dict[str, Column] = {}
        cond = self._column(tree, df, found)
        if not found:
            return df.where(cond)
        # Aggregates over the survivors: one row, joined back without a key; its size is one row by construction.
        scalars = df.agg(*[x.alias(name) for name, x in found.items()])
        return df.join(F.broadcast(scalars)).where(cond).drop(*found)

    def _column(self, node: ast.expr, df: DataFrame, found: dict[str, Column]) -> Column:
        go = lambda n: self._column(n, df, found)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float, str, bool)):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in df.columns:
                return F.col(node.id)
            return F.col(self.id).cast("string") == F.lit(node.id)  # an id that is used as a tag
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Invert, ast.Not)):
            return ~go(node.operand)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -go(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](go(node.left), go(node.right))
        if isinstance(node, ast.BoolOp):
            out = go(node.values[0])
            for v in node.values[1:]:
                out = (out & go(v)) if isinstance(node.op, ast.And) else (out | go(v))
            return out
        if isinstance(node, ast.Compare):
            sides, out = [node.left, *node.comparators], None
            for a, op, b in zip(sides, node.ops, sides[1:], strict=False):
                if type(op) not in _COMPARE:
                    raise QueryError(f"comparison {type(op).__name__} is not allowed")
                own = _COMPARE[type(op)](go(a), go(b))
                out = own if out is None else out & own
            return out
        if isinstance(node, ast.Subscript) and isinstance(node.slice, ast.Constant) and isinstance(node.slice.value, int):
            return F.get(go(node.value), F.lit(node.slice.value))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
            name, args = node.func.id, node.args
            if name in self.functors:
                return self.functors[name](df)(*map(go, args))
            if name in self.functions:
                return self.functions[name](*map(go, args))
            if name in AGGREGATES and len(args) == 1:
                key = f"_agg{len(found)}"
                inner: dict[str, Column] = {}
                found[key] = AGGREGATES[name](self._column(args[0], df, inner))
                if inner:
                    raise QueryError("aggregates don't nest")
                return F.col(key)
            if name in SCALARS:
                return SCALARS[name](*map(go, args))
            if name == "isin" and len(args) == 2 and isinstance(args[1], (ast.List, ast.Tuple)):
                return go(args[0]).isin([n.value for n in args[1].elts if isinstance(n, ast.Constant)])
        raise QueryError(f"{ast.dump(node)[:60]} is not allowed")

    def _ordered(self, df: DataFrame, tail: str, places: bool) -> DataFrame:
        """Sort and slice. A slice from the start with a positive stop is a limit; others number the rows."""
        if not tail.strip() and not places:
            return df
        name, *brackets = tail.replace("]", "").split("[")
        name = name.strip() or self.sort or self.id
        if name not in df.columns:
            raise QueryError(f"cannot sort by {name}")
        key = F.col(name)
        if len(brackets) > 1:
            key = F.get(key, F.lit(int(brackets[0])))
        order = [key.asc_nulls_last(), F.col(self.id).asc_nulls_last()]
        cut = brackets[-1] if brackets else ""
        parts = [int(p) if p.strip() else None for p in cut.split(":")] if cut else [None, None]
        if len(parts) == 1:
            start, stop, step = parts[0], (parts[0] + 1) or None, 1
        else:
            start, stop, step = (*parts, None)[:3]
            step = 1 if step is None else step
        if step == 0:
            raise QueryError("a slice needs a step")
        if not start and step == 1 and stop is not None and stop >= 0:
            top = df.orderBy(*order).limit(stop)
            place = F.row_number().over(W.orderBy(*order)).cast("long") - 1  # of the rows of the slice
            return top.withColumn("_pos", place) if stop else df.limit(0).withColumn("_pos", F.lit(0).cast("long"))
        if (start, stop, step) == (None, None, 1) and not places:
            return df.orderBy(*order)
        numbered = in_order(df, order, "_pos")
        if (start, stop, step) == (None, None, 1):
            return numbered
        if (start is not None and start < 0) or (stop is not None and stop < 0) or step < 0:
            numbered = numbered.join(F.broadcast(numbered.agg(F.count(F.lit(1)).alias("_n"))))
        else:
            numbered = numbered.withColumn("_n", F.lit(None).cast("long"))
        n, pos = F.col("_n"), F.col("_pos")
        at = lambda v: F.lit(v) if v >= 0 else n + v
        if step > 0:
            low = F.lit(0) if start is None else F.greatest(at(start), F.lit(0))
            keep = (pos >= low) & ((pos - low) % step == 0)
            keep = keep if stop is None else keep & (pos < at(stop))
            return numbered.where(keep).drop("_n")
        high = n - 1 if start is None else F.least(at(start), n - 1)
        keep = (pos <= high) & ((high - pos) % -step == 0)
        keep = keep if stop is None else keep & (pos > at(stop))
        return numbered.where(keep).withColumn("_pos", F.floor((high - pos) / -step)).drop("_n")

    def with_defaults(self, **values: object) -> TagTable:
        """Columns that are always there: missing ones are added with a value."""
        new = {k: F.lit(v) for k, v in values.items() if k not in self.df.columns}
        return TagTable(self.df.withColumns(new), self.id, self.sort, self.default, self.lists, self.functions, self.functors)

    def tags(self) -> list[str]:
        return sorted(self.df.columns)

    def select(self, ids: DataFrame) -> TagTable:
        """Rows with the given ids, in the list's order (column `_pos`); settings are kept."""
        df = self.df.join(ids.select(F.col(self.id), F.col("_pos")), self.id)
        return TagTable(df, self.id, self.sort, self.default, self.lists, self.functions, self.functors)
