"""Row patterns as set operations: MATCH_RECOGNIZE whose conditions are SQL, without Python.

    RowPattern(["k"], ["ts"], "START DOWN+ UP", {"DOWN": "DOWN.price < LAST(DOWN.price, 1)", ...}, {"bottom": "LAST(DOWN.price)"})

How it runs:

1. A condition looks back: at its own row and at earlier rows of the match. How far back
   ``LAST(DOWN.price, 1)`` is depends on the rows matched before, of which only few counts
   matter. So each variable is taken once for each such context, and its condition becomes
   an expression over the row and rows a fixed distance before it (``lag``).
2. Two neighbouring rows that no context allows next to one another part a key's rows:
   no match spans them. Rows between two partings are a segment, which is searched alone.
   Rows that fit no context are dropped there.
3. In a segment each row is a token of bits, one for each context it fits. The pattern is
   a regular expression over tokens, whose greedy backtracking is that of row patterns; the
   skip clause says how much of a match it consumes, the rest being lookahead.
4. Measures are array functions of the rows of each step.

``lag`` and the numbering of segments work within (key, time slice). A slice begins with
copies of the last few rows before it, and takes over the number of segments before it,
from a row per key and slice. So no key's rows meet in one task, but those of a segment.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .match import parse

_REF = re.compile(r"'(?:[^']|'')*'|\b(?:(LAST|FIRST|PREV)\s*\(\s*([A-Za-z_]\w*)\.(\w+)\s*(?:,\s*(\d+)\s*)?\)|([A-Za-z_]\w*)\.(\w+))", re.I)
_AGGREGATE = re.compile(r"\b(AVG|SUM|COUNT|MIN|MAX)\s*\(", re.I)
#: With these an unknown operand can decide a condition, so three-valued logic says nothing of it.
_OPAQUE = re.compile(r"\{null\}\s*(IS\b|<=>)|<=>\s*\{null\}|\b(COALESCE|CASE|IF|IFNULL|NVL2?|ISNULL|ISNOTNULL)\b", re.I)
#: Counts up to which a finite repetition is written out.
WRITTEN_OUT = 16


@dataclass(frozen=True)
class _Ref:
    """A reference to a column of a variable's row: bare, or the LAST, FIRST or (by rows) PREV with an offset."""

    how: str
    name: str
    column: str
    off: int


def _ref(m: re.Match) -> _Ref | None:
    if m[0].startswith("'"):
        return None
    how = (m[1] or "").upper()
    return _Ref(how, (m[2] or m[5]).upper(), m[3] or m[6], int(m[4] or (how == "PREV")))


def _refs(text: str) -> list[_Ref]:
    return [r for m in _REF.finditer(text) if (r := _ref(m))]


def _rewrite(text: str, put: Callable[[_Ref], str | None]) -> str:
    """The text with references replaced; those that ``put`` gives None for stay."""
    return _REF.sub(lambda m: (put(r) if (r := _ref(m)) else None) or m[0], text)


@dataclass(frozen=True)
class RowPattern:
    """The clauses of a row pattern. Conditions and measures are SQL that names columns as ``VARIABLE.column``.

    after: "PAST LAST ROW", "TO NEXT ROW", "TO FIRST v" or "TO LAST v". within: the
    longest time (as in INTERVAL '1' SECOND) from a match's first row to its last.
    """

    partition_by: list[str]
    order_by: list[str]
    pattern: str
    define: dict[str, str]
    measures: dict[str, str]
    after: str = "PAST LAST ROW"
    within: str | None = None


@dataclass
class _Count:
    """Rows of a step so far: n, or n and more."""

    n: int
    exact: bool


@dataclass
class _Compiler:
    spec: RowPattern
    steps: list[tuple[str, int, float]]
    symbols: list[str] = field(default_factory=list)
    lags: dict[tuple[str, int], str] = field(default_factory=dict)
    follow: set[tuple[int, int]] = field(default_factory=set)
    groups: int = 0
    #: Per way through the contexts: the group of each step, and that of the last row to skip to.
    leaves: list[tuple[list[int], int | None]] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [s[0].upper() for s in self.steps]
        if len(set(names)) < len(names):
            raise ValueError("a variable may occur once in a pattern")
        self.at = {n: i for i, n in enumerate(names)}
        self.define = {k.upper(): v for k, v in self.spec.define.items()}
        self.cap = 2 + max((r.off for text in self.define.values() for r in _refs(text)), default=0)
        words = self.spec.after.upper().split()
        self.skip, self.target = words[0] if words[0] == "PAST" else words[1], self.at.get(words[-1])
        if self.skip in ("FIRST", "LAST") and (self.target is None or self.steps[self.target][1] == 0):
            raise ValueError("the skip clause must name a variable that every match has")
        if not any(least for _, least, _ in self.steps):
            raise ValueError("a pattern must need a row")
        self.depth = 0

    def lag(self, column: str, back: int) -> str:
        if back == 0:
            return f"`{column}`"
        self.depth = max(self.depth, back)
        return self.lags.setdefault((column, back), f"`_lag{back}_{column}`")

    def resolve(self, step: int, counts: list[_Count]) -> str:
        """A step's condition after so many rows of each step, its own row counted; unknown operands are {null}."""
        own = counts[step]

        def distance(how: str, of: int, off: int) -> int | None | str:
            n = counts[of]
            if n.n <= off:
                return None if n.exact else "unknown"
            if of == step and how == "LAST":
                return off
            between = counts[of + 1 : step + 1]
            if how == "FIRST":
                between, off = counts[of : step + 1], off + 1
                return sum(c.n for c in between) - off if all(c.exact for c in between) else "unknown"
            return sum(c.n for c in between) + off if all(c.exact for c in between) else "unknown"

        def put(r: _Ref) -> str:
            if r.how == "PREV":
                return self.lag(r.column, r.off)
            if r.name not in self.at:
                raise ValueError(f"{r.name} is no variable of the pattern")
            of = self.at[r.name]
            found = None if of > step else distance(r.how or "LAST", of, r.off)
            return "NULL" if found is None else "{null}" if found == "unknown" else self.lag(r.column, found)

        text = f"({_rewrite(self.define.get(self.steps[step][0].upper(), 'true'), put)})"
        if "{null}" in text and _OPAQUE.search(text):
            text = "CAST({null} AS BOOLEAN)"
        if self.spec.within and step + own.n > 0:
            ts, so_far = self.spec.order_by[0], sum(c.n for c in counts[: step + 1]) - 1
            if so_far:
                late = f"{self.lag(ts, 0)} <= {self.lag(ts, so_far)} + {self.spec.within}"
                text = f"({text} AND {late})" if all(c.exact for c in counts[: step + 1]) else f"({text} AND {late} AND CAST({{null}} AS BOOLEAN))"
        return text

    def symbol(self, step: int, counts: list[_Count]) -> int:
        text = self.resolve(step, counts)
        if text not in self.symbols:
            self.symbols.append(text)
        return self.symbols.index(text)

    def forks(self, step: int) -> bool:
        """Whether a later condition depends on how many rows the step has."""
        if self.spec.within and step + 1 < len(self.steps):
            return True
        for later, _, _ in self.steps[step + 1 :]:
            for r in _refs(self.define.get(later.upper(), "")):
                of = self.at.get(r.name, len(self.steps))
                if r.how != "PREV" and (of < step or (of == step and (r.off or r.how == "FIRST" or self.steps[step][1] == 0))):
                    return True
        return False

    def build(self, step: int, counts: list[_Count], ends: set[int], taken: list[int], last: int | None) -> Callable[[Callable[[int], str], str], str]:
        """A function from the forms of symbols and of any row to the expression of the steps from here on."""
        if step == len(self.steps):
            self.leaves.append((taken, last))
            return lambda sym, row: ""
        name, least, most = self.steps[step]
        if most != float("inf") and most > WRITTEN_OUT:
            raise ValueError(f"repetitions above {WRITTEN_OUT} must be open")
        top = int(most) if most != float("inf") else max(self.cap, least)
        ways = [(top, most == top), *[(n, True) for n in range(top - 1, least - 1, -1)]] if self.forks(step) else [(top, False)]
        parts = []
        for n, exact in ways:
            seq = [self.symbol(step, [*counts, _Count(k, True)]) for k in range(1, n + 1)]
            more = self.symbol(step, [*counts, _Count(n + 1, False)]) if most == float("inf") and n == top else None
            first_stop = n if len(ways) > 1 else least
            for a in ends if seq else ():
                self.follow.add((a, seq[0]))
            self.follow.update(zip(seq, seq[1:], strict=False))
            if more is not None:
                self.follow.update({(seq[-1], more), (more, more)})
            now = {s for k, s in enumerate(seq, 1) if k >= max(1, first_stop)} | ({more} if more is not None else set()) | (ends if first_stop == 0 else set())
            self.groups += 1
            group, mark = self.groups, last
            if step == self.target and self.skip == "LAST":
                self.groups += 1
                mark = self.groups
            count = _Count(n, exact) if len(ways) > 1 else _Count(least, least == most)
            rest = self.build(step + 1, [*counts, count], now, [*taken, group], mark)

            def part(sym: Callable[[int], str], row: str, seq=seq, more=more, first_stop=first_stop, rest=rest, marked=mark != last) -> str:
                text = f"(?:{sym(more)})*" if more is not None else ""
                for k in range(len(seq), 0, -1):
                    text = sym(seq[k - 1]) + text
                    text = f"(?:{text})?" if k > first_stop else text
                return f"({text})" + (f"(?<=({row}))" if marked else "") + rest(sym, row)

            parts.append(part)
        return lambda sym, row: parts[0](sym, row) if len(parts) == 1 else "(?:" + "|".join(p(sym, row) for p in parts) + ")"

    def regex(self) -> str:
        whole = self.build(0, [], set(), [], None)
        n = len(self.symbols)
        row = rf"\|[01]{{{n}}}\d{{8}}"
        sym = lambda k: rf"\|[01]{{{k}}}1[01]{{{n - k - 1}}}\d{{8}}"
        text = whole(sym, row)
        if self.skip == "PAST":
            return text
        if self.skip == "NEXT":
            return f"(?={text}){row}"
        ways = []
        for taken, last in self.leaves:
            before = "".join(rf"(?:\{g})" for g in taken[: self.target])
            if self.skip == "LAST":
                ways.append(rf"{before}(?:{row})*?(?=\{last})" if self.target else rf"(?:{row})+?(?=\{last})")
            elif self.target:
                ways.append(before)
        return f"(?={text})(?:{'|'.join([*ways, row])})"


def _aggregated(kind: str, inner: str, variables: list[str]) -> str:
    used = {r.name for r in _refs(inner)}
    if inner == "*":
        return f"CAST({' + '.join(f'size(_rows_{v})' for v in variables)} AS BIGINT)"
    if len(used) != 1 or not used <= set(variables):
        raise ValueError("an aggregate takes one variable's rows, or COUNT(*)")
    one = _rewrite(inner, lambda r: f"_r.`{r.column}`")
    values = f"filter(transform(_rows_{used.pop()}, _r -> {one}), _x -> _x IS NOT NULL)"
    total = f"aggregate({values}, 0D, (_a, _x) -> _a + CAST(_x AS DOUBLE))"
    forms = {"COUNT": f"CAST(size({values}) AS BIGINT)", "MIN": f"array_min({values})", "MAX": f"array_max({values})", "SUM": f"IF(size({values}) = 0, NULL, {total})", "AVG": f"{total} / nullif(size({values}), 0)"}
    return forms[kind]


def _measure(text: str, variables: list[str]) -> str:
    """A measure as SQL over arrays ``_rows_VARIABLE``."""
    out = ""
    while m := _AGGREGATE.search(text):
        depth, at = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        out += _bare(text[: m.start()], variables) + _aggregated(m[1].upper(), text[m.end() : at - 1].strip(), variables)
        text = text[at:]
    return out + _bare(text, variables)


def _bare(text: str, variables: list[str]) -> str:
    def put(r: _Ref) -> str | None:
        if r.name not in variables:
            return None
        return f"get(_rows_{r.name}, {r.off if r.how == 'FIRST' else f'size(_rows_{r.name}) - {1 + r.off}'}).`{r.column}`"

    return _rewrite(text, put)


def recognize(df: DataFrame, spec: RowPattern, *, slice_s: int = 86_400) -> DataFrame:
    """ONE ROW PER MATCH: the partition columns and the measures, of a bounded table.

    The first order column is a time; rows tied in the order columns follow by the other
    columns that the pattern uses. Conditions must be decidable from rows a fixed distance
    away, or come out alike whatever rows further away hold; a row of which neither is
    true stops the query. Null counts as false. Keys may be null. An empty table gives no rows.
    """
    steps = parse(spec.pattern)
    variables = [name.upper() for name, _, _ in steps]
    c = _Compiler(spec, steps)
    regex, n_bits = c.regex(), len(c.symbols)
    keys = list(spec.partition_by)
    named = [r.column for text in [*spec.define.values(), *spec.measures.values()] for r in _refs(text) if r.name in variables]
    used = [x for x in dict.fromkeys([*spec.order_by, *named]) if x not in keys]
    order = [F.col(f"`{x}`") for x in used]
    rows = df.select(*keys, *used, F.floor(F.unix_seconds(F.col(spec.order_by[0]).cast("timestamp")) / slice_s).alias("_slice"), F.lit(False).alias("_ghost"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    of_key = Window.partitionBy(*keys)
    depth = c.depth + 1  # the row before a slice needs rows before it
    row = F.struct(*[F.col(f"`{x}`") for x in used])
    back = Window.partitionBy(*keys, "_slice").orderBy(*[o.desc() for o in order])
    tails = rows.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= depth)
    ends = tails.select(*keys, "_slice", "_back", F.collect_list(row).over(of_key.orderBy("_slice", F.desc("_back")).rowsBetween(1 - depth, 0)).alias("_tail")).where("_back = 1")
    ends = ends.withColumn("_slice", F.lead("_slice").over(of_key.orderBy("_slice"))).where("_slice IS NOT NULL")
    ghosts = ends.select(*keys, "_slice", F.explode("_tail").alias("_t"))
    rows = rows.unionByName(ghosts.select(*keys, *[F.col(f"_t.`{x}`").alias(x) for x in used], "_slice", F.lit(True).alias("_ghost")))
    rows = rows.select("*", *[F.lag(f"`{col}`", n).over(inside).alias(name.strip("`")) for (col, n), name in c.lags.items()])
    bits = [f"_b{i}" for i in range(n_bits)]
    unsure = [i for i, text in enumerate(c.symbols) if "{null}" in text]
    kept = [*keys, *used, "_slice", "_ghost"]
    rows = rows.select(*kept, *[F.expr(text.replace("{null}", "NULL")).cast("boolean").alias(b) for b, text in zip(bits, c.symbols, strict=True)])
    rows = rows.select(*kept, *[F.col(b).isNull().alias(f"_u{i}") for i, b in enumerate(bits) if i in unsure], *[F.coalesce(b, F.lit(i in unsure)).alias(b) for i, b in enumerate(bits)])
    after = {b: F.coalesce(F.lag(f"_b{b}").over(inside), F.lit(False)).alias(f"_p{b}") for b in sorted({a for a, _ in c.follow})}
    rows = rows.select("*", *after.values())
    joined = reduce(or_, [F.col(f"_p{a}") & F.col(f"_b{b}") for a, b in sorted(c.follow)], F.lit(False))
    doubt = reduce(or_, [F.col(f"_p{a}") & F.col(f"_u{b}") for a, b in sorted(c.follow) if b in unsure], F.lit(False))
    rows = rows.select(*kept, *bits, doubt.alias("_doubt"), (~joined).cast("long").alias("_cut")).where("NOT _ghost")
    numbered = rows.withColumn("_seg", F.sum("_cut").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    per_slice = rows.groupBy(*keys, "_slice").agg(F.sum("_cut").alias("_cuts"))
    before = per_slice.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_of"), F.coalesce(F.sum("_cuts").over(of_key.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col("_slice").eqNullSafe(F.col("_of"))
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    fits = reduce(or_, [F.col(b) for b in bits])
    placed = numbered.where(fits).join(before, same).withColumn("_seg", F.col("_seg") + F.col("_before"))

    token = F.concat(F.lit("|"), *[F.when(F.col(b), "1").otherwise("0") for b in bits])
    member = F.struct(*[F.col(f"`{x}`") for x in used], *[F.col(f"`{k}`") for k in keys], token.alias("_token"), F.col("_doubt"))
    segments = placed.groupBy(*keys, "_seg").agg(F.array_sort(F.collect_list(member)).alias("_rows"))
    segments = segments.where(F.size("_rows") >= sum(least for _, least, _ in steps))
    text = F.array_join(F.transform("_rows", lambda r, i: F.concat(r["_token"], F.lpad(i.cast("string"), 8, "0"))), "")
    if unsure:
        stop = F.raise_error(F.lit("a row pattern's condition depends on rows at no fixed distance; use operators.match with Python functions"))
        text = F.when(F.exists("_rows", lambda r: r["_doubt"]), stop.cast("string")).otherwise(text)
    segments = segments.withColumn("_text", text).where(F.regexp_like("_text", F.lit(regex)))
    parts = {v: sorted({taken[i] for taken, _ in c.leaves}) for i, v in enumerate(variables)}
    groups = [F.regexp_extract_all("_text", F.lit(regex), F.lit(g)).alias(f"_g{g}") for gs in parts.values() for g in gs]
    matches = segments.select(*keys, "_rows", *groups).select(*keys, "_rows", F.explode(F.arrays_zip(*[f"_g{g}" for gs in parts.values() for g in gs])).alias("_m"))
    for v, gs in parts.items():
        taken = F.concat(*[F.col(f"_m._g{g}") for g in gs])
        first = F.substring(taken, n_bits + 2, 8).cast("int") + 1
        matches = matches.withColumn(f"_rows_{v}", F.when(F.length(taken) > 0, F.slice("_rows", first, (F.length(taken) / (n_bits + 9)).cast("int"))).otherwise(F.slice("_rows", 1, 0)))
    return matches.select(*keys, *[F.expr(_measure(text, variables)).alias(name) for name, text in spec.measures.items()])
