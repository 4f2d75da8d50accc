"""Per-document operators as layers of SQL expressions, written once and rendered for Spark and for DuckDB.

A layer names columns computed from the columns of the layers below. Spark gets them as `withColumns`, so that a list of
tokens or sentences is built once and unused columns are pruned; DuckDB gets nested selects, which is how results are
checked by another engine. Everything stays in built-in functions of either engine.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"[\x09-\x0D\x20]"


class Spark:
    name = "spark"

    def re(self, p: str) -> str:
        return "r'" + p.replace("'", r"\x27") + "'"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def count(self, t, p):
        return f"regexp_count({t}, {self.re(p)})"

    def matches(self, t, p):
        return f"({t} rlike {self.re(p)})"

    def extract(self, t, p):
        return f"regexp_extract_all({t}, {self.re(p)}, 0)"

    def replace(self, t, p, to):
        return f"regexp_replace({t}, {self.re(p)}, {self.lit(to)})"

    def split(self, t, p):
        return f"split({t}, {self.re(p)})"

    def map(self, a, v, body):
        return f"transform({a}, {v} -> {body})"

    def map_at(self, a, v, i, body):
        """i counts from 0."""
        return f"transform({a}, ({v}, {i}) -> {body})"

    def keep(self, a, v, body):
        return f"filter({a}, {v} -> {body})"

    def total(self, a):
        return f"aggregate({a}, 0D, (s_, x_) -> s_ + x_)"

    def size(self, a):
        return f"size({a})"

    def uniq(self, a):
        return f"array_distinct({a})"

    def at(self, a, i):
        """i counts from 0; NULL outside."""
        return f"get({a}, cast({i} as int))"

    def seq(self, n):
        """0 .. n - 1."""
        return f"(case when {n} > 0 then sequence(0, cast({n} as int) - 1) else cast(array() as array<int>) end)"

    def part(self, a, k, n):
        """n elements from place k, counted from 0."""
        return f"slice({a}, cast({k} as int) + 1, {n})"

    def most(self, a):
        return f"array_max({a})"

    def has(self, a, x):
        return f"array_contains({a}, {x})"

    def among(self, x, xs):
        """Whether x is one of fixed strings: a look-up in a set, not a walk along a list."""
        return f"({x} in (" + ", ".join(self.lit(v) for v in dict.fromkeys(xs)) + "))"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def words(self, xs):
        return "array(" + ", ".join(self.lit(x) for x in xs) + ")"

    def join(self, a, by):
        return f"array_join({a}, {self.lit(by)})"

    def grams(self, a, n):
        """Runs of n neighbours joined by a space: shifted copies side by side, linear in the list's length."""
        out = a
        for k in range(1, n):
            out = f"zip_with({out}, slice({a}, {k + 1}, greatest(size({a}) - {k}, 0)), (x_, y_) -> concat(x_, ' ', y_))"
        return f"slice({out}, 1, greatest(size({a}) - {n - 1}, 0))"

    def lookup(self, table, x):
        """The number that a fixed table has for x; NULL where it has none."""
        return "try_element_at(map(" + ", ".join(f"{self.lit(k)}, {v}D" for k, v in table.items()) + f"), {x})"

    def struct(self, **fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def sort(self, a):
        return f"sort_array({a})"

    def chain(self, a, b):
        return f"concat({a}, {b})"

    def union(self, a, b):
        return f"array_union({a}, {b})"

    def begins(self, t, x):
        return f"startswith({t}, {x})"

    def stretch(self, a, k, n):
        """n elements from place k, counted from 0, where n is an expression."""
        return f"slice({a}, cast({k} as int) + 1, cast({n} as int))"

    def sha32(self, t):
        return f"cast(conv(substring(sha2({t}, 256), 1, 8), 16, 10) as bigint)"

    def long(self, x):
        return f"cast({x} as bigint)"

    def integer_part(self, a, b):
        return f"({a} div {b})"


class Duck(Spark):
    name = "duckdb"

    def re(self, p):
        return "'" + p.replace("'", "''") + "'"

    lit = re

    def count(self, t, p):
        return f"len(regexp_extract_all({t}, {self.re(p)}))"

    def matches(self, t, p):
        return f"regexp_matches({t}, {self.re(p)})"

    def extract(self, t, p):
        return f"regexp_extract_all({t}, {self.re(p)})"

    def replace(self, t, p, to):
        return f"regexp_replace({t}, {self.re(p)}, {self.re(to.replace('$', chr(92)))}, 'g')"

    def split(self, t, p):
        return f"regexp_split_to_array({t}, {self.re(p)})"

    def map(self, a, v, body):
        return f"list_transform({a}, lambda {v}: {body})"

    def map_at(self, a, v, i, body):
        return f"list_transform(list_zip({a}, range(0, len({a}))), lambda z_: {body.replace(f'<{v}>', 'z_[1]').replace(f'<{i}>', 'z_[2]')})"

    def keep(self, a, v, body):
        return f"list_filter({a}, lambda {v}: {body})"

    def total(self, a):
        return f"coalesce(list_sum(list_transform({a}, lambda x_: CAST(x_ AS DOUBLE))), 0)"

    def size(self, a):
        return f"len({a})"

    def uniq(self, a):
        return f"list_distinct({a})"

    def at(self, a, i):
        return f"({a})[CAST({i} AS BIGINT) + 1]"

    def seq(self, n):
        return f"range(0, CAST({n} AS BIGINT))"

    def part(self, a, k, n):
        return f"list_slice({a}, CAST({k} AS BIGINT) + 1, CAST({k} AS BIGINT) + {n})"

    def most(self, a):
        return f"list_max({a})"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def words(self, xs):
        return "[" + ", ".join(self.lit(x) for x in xs) + "]"

    def join(self, a, by):
        return f"array_to_string({a}, {self.lit(by)})"

    def grams(self, a, n):
        parts = " || ' ' || ".join(f"({a})[i_ + {k}]" for k in range(1, n + 1))
        return f"list_transform(range(0, greatest(len({a}) - {n - 1}, 0)), lambda i_: {parts})"

    def lookup(self, table, x):
        return "([" + ", ".join(f"CAST({v} AS DOUBLE)" for v in table.values()) + "])[list_position([" + ", ".join(self.lit(k) for k in table) + f"], {x})]"

    def struct(self, **fields):
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def sort(self, a):
        return f"list_sort({a})"

    def chain(self, a, b):
        return f"list_concat({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def begins(self, t, x):
        return f"starts_with({t}, {x})"

    def stretch(self, a, k, n):
        return f"list_slice({a}, CAST({k} AS BIGINT) + 1, CAST({k} AS BIGINT) + CAST({n} AS BIGINT))"

    def sha32(self, t):
        return f"CAST(('0x' || substr(sha256({t}), 1, 8)) AS UBIGINT)"

    def integer_part(self, a, b):
        return f"({a} // {b})"


def indexed(d: Spark, a: str, body: str, v: str = "w", i: str = "k") -> str:
    """Map with the place from 0; body names the element <w> and the place <k>."""
    if d.name == "spark":
        return d.map_at(a, "e__", "k__", body.replace(f"<{v}>", "e__").replace(f"<{i}>", "k__"))
    return d.map_at(a, v, i, body)


def held(x: str) -> str:
    """A column that a lambda looks at, named twice so that the optimiser does not put what computes it into the lambda."""
    return f"(0.5D * {x} + 0.5D * {x})"


def rounded(x: str, digits: int) -> str:
    """Half up at that digit, in either engine."""
    f = 10**digits
    return f"(floor(({x}) * {f} + 0.5D) / {f})" if digits else f"floor({x} + 0.5D)"


class Keep(list):
    """A layer that keeps the columns it lists, and the id, and drops the others."""


@dataclass
class Arrow:
    """A column computed from others over Arrow batches, where a layer has one in place of an expression; Spark only."""

    function: object
    columns: list[str]
    type: str = "double"


def column(x: str | Arrow) -> Column:
    """What a layer says of a column, for Spark."""
    if isinstance(x, Arrow):
        f = x.function
        return F.arrow_udf(lambda *columns: f(*columns), x.type)(*x.columns)
    return F.expr(x)


@dataclass
class Operator:
    """layers(dialect) -> list of {column: expression} or Keep; out: the columns returned besides the id.

    A layer may compute a column anew; its expressions see the columns as they were before it."""

    layers: object
    out: list[str]
    source: str = "documents"
    key: str = "doc_id"
    extra: list[str] = field(default_factory=list)

    def apply(self, df: DataFrame) -> DataFrame:
        """Over a batch or a streaming DataFrame."""
        df = df.select(self.key, *self.extra)
        for layer in self.layers(Spark()):
            df = df.select(self.key, *layer) if isinstance(layer, Keep) else df.withColumns({c: column(x) for c, x in layer.items()})
        return df.select(self.key, *self.out)

    def sql(self, source: str | None = None) -> str:
        q, have = f"SELECT {', '.join([self.key, *self.extra])} FROM {source or self.source}", {self.key, *self.extra}
        for layer in self.layers(Duck()):
            if isinstance(layer, Keep):
                q, have = f"SELECT {', '.join([self.key, *layer])} FROM ({q})", {self.key, *layer}
                continue
            again = ", ".join(f"{_duck_numbers(x)} AS {c}" for c, x in layer.items() if c in have)
            new = "".join(f", {_duck_numbers(x)} AS {c}" for c, x in layer.items() if c not in have)
            q = f"SELECT *{f' REPLACE ({again})' if again else ''}{new} FROM ({q})"
            have |= set(layer)
        return f"SELECT {', '.join([self.key, *self.out])} FROM ({q})"


def _duck_numbers(x: str) -> str:
    """Spark's double literals (0.5D) as DuckDB writes them."""
    return re.sub(r"(?<![\w'{])(\d+(?:\.\d+)?)D\b", r"CAST(\1 AS DOUBLE)", x)
