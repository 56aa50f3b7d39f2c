"""Three-way match: invoice lines against purchase-order lines against what was received.

Lines come as rows - case_id, pos and a map of fieldtype to printed texts - for each side; headers
likewise, one row a case and side. A case's lines are gathered into one row, and from there on everything is done
within that row: `_cell_list` resolves the lines' cells, `_paired` assigns them one to one for the
greatest total worth, and the rules draw findings and the list of what could not be compared from
the pairs. Nothing but the lines themselves is shuffled, and nothing is written between.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerloom.functions import normalize
from ledgerloom.operators import assignment

# Each cell's fieldtypes, the first carried wins.
CELLS = {
    "unit price": ("line_item_unit_price_gross", "line_item_unit_price_net"),
    "amount": ("line_item_amount_gross", "line_item_amount_net"),
    "quantity": ("line_item_quantity",),
    "unit": ("line_item_units_of_measure",),
    "code": ("line_item_code",),
    "description": ("line_item_description",),
    "tax": ("amount_total_tax",),
}
LINE_CELLS = ("unit price", "amount", "quantity", "unit", "code", "description")
VALUE_CELLS = ("quantity", "unit price", "amount")
PAIRING_CELLS = ("code", "description", *VALUE_CELLS)
PRICE_CELLS = ("unit price", "amount")
# Fixed value: cases with more lines than this on both sides are assigned in Python, which solves them faster; the others stay in the JVM.
MANY = 64
# The least similarity that counts as identity, and the discrepancy types in report order with their severity.
FLOORS = {"code": 0.5, "description": 0.4}
SEVERITY = {
    "price variance": "hold", "short-ship": "hold", "over-ship": "hold", "extra line": "hold", "missing line": "note", "unit variant": "hold", "tax mismatch": "hold",
}
TYPES = tuple(SEVERITY)
NEAR_SHARE, FAR_SHARE = "0.02", "0.50"

AMOUNT = "decimal(28,8)"


class Tolerance(NamedTuple):
    """How far a value may be above what it is compared with: a share of that, and a sum; both must be passed."""

    percent: str
    cent: str

    def margin(self, value: str) -> str:
        return f"cast(cast('{self.percent}' as decimal(5,4)) * {value} as decimal(32,10))"

    def exceeded(self, value: str, against: str) -> str:
        return f"({value} - {against} > {self.margin(against)} and {value} - {against} > cast('{self.cent}' as decimal(5,2)))"


MONEY, EXACT = Tolerance("0.01", "0.01"), Tolerance("0", "0")


def band(value: str, against: str, tolerance: Tolerance = MONEY) -> Column:
    """`near` or `far` by how much a value (an SQL expression of decimals) is over; null within the tolerance and beyond the far band."""
    over = f"{value} - {against}"
    return F.expr(f"case when {tolerance.exceeded(value, against)} then case when {over} <= {NEAR_SHARE} * {against} then 'near' when {over} <= {FAR_SHARE} * {against} then 'far' end end")


def quantity_band(value: Column, lowered: Column) -> Column:
    """`near` for one unit over, `far` for two or more up to double; else null."""
    over = value - lowered
    return F.when(over == 1, "near").when((over >= 2) & (value <= 2 * lowered), "far")


# --- cells -----------------------------------------------------------------------------------------

def _named(cell: str) -> str:
    return cell.replace(" ", "_")


def _texts(fields: str, cell: str) -> str:
    """The texts of the first of a cell's fieldtypes that carries one; null where none does. A blank text is none. A single text, the common case, needs no filter."""
    of = lambda f: f"{fields}['{f}']"
    kept = [f"case when size({of(f)}) = 1 then case when {of(f)}[0] rlike '\\\\S' then {of(f)} end else get(filter(array(filter({of(f)}, x -> x rlike '\\\\S')), k -> size(k) > 0), 0) end" for f in CELLS[cell]]
    return f"coalesce({', '.join(kept)})" if len(kept) > 1 else kept[0]


def _text_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\\\s+', ' ')))"


def _numbers(texts: str) -> str:
    """Each text as a number; one of digits and one point at most is its own plain form."""
    plain = lambda x: f"{x} rlike '^[0-9]{{1,18}}([.][0-9]{{1,8}})?$'"
    read = f"transform({texts}, x -> case when {plain('x')} then try_cast(x as {AMOUNT}) else try_cast({normalize.number_sql('x')} as {AMOUNT}) end)"
    return f"case when size({texts}) = 1 and {plain(f'{texts}[0]')} then array(try_cast({texts}[0] as {AMOUNT})) else {read} end"


def _compared(cell: str, texts: str) -> dict[str, str]:
    """What is worked out from a cell's texts, as SQL by the end of its name."""
    if cell in (*VALUE_CELLS, "tax"):
        return {"_n": _numbers(texts)}
    return {"_t": f"case when size({texts}) = 1 then array({_text_sql(f'{texts}[0]')}) else array_sort(array_distinct(transform({texts}, x -> {_text_sql('x')}))) end"}


def _derived(names: tuple[str, ...], of: str = "") -> list[str]:
    return [f"{sql} as {_named(c)}{end}" for c in names for end, sql in _compared(c, of + _named(c)).items()]


def cells(lines: DataFrame, *keep: str, names: tuple[str, ...] = LINE_CELLS) -> DataFrame:
    """For each cell, its texts as printed (null if absent), `_n`: each read as a number (null where
    it doesn't read), and `_t`: each as compared text, distinct and in order. `lines` has a map
    `fields` of fieldtype to an array of texts; null maps, arrays and texts are absent."""
    out = lines.selectExpr(*keep, *[f"{_texts('fields', c)} as {_named(c)}" for c in names])
    return out.selectExpr("*", *_derived(names))


def _cell_list(lines: str, place: str, names: tuple[str, ...] = LINE_CELLS) -> str:
    """`cells` of an array of structs of a place and `fields`, as SQL."""
    resolved = f"transform({lines}, l -> struct(l.{place} as {place}, {', '.join(f'{_texts("l.fields", c)} as {_named(c)}' for c in names)}))"
    return f"transform({resolved}, c -> struct(c.{place} as {place}, {', '.join(f'c.{_named(c)} as {_named(c)}' for c in names)}, {', '.join(_derived(names, 'c.'))}))"


def _name_list(lines: str) -> str:
    """What pairing first asks of an array of structs of pos and `fields`, as SQL: pos, what a line is called as compared text, and whether it has anything to pair on."""
    resolved = f"transform({lines}, l -> struct(l.pos as pos, l.fields as fields, {', '.join(f'{_texts("l.fields", c)} as {c}' for c in FLOORS)}))"
    bare = f"coalesce({', '.join(_texts('c.fields', c) for c in VALUE_CELLS)}) is not null"
    named = " or ".join(f"c.{c} is not null" for c in FLOORS)
    return f"transform({resolved}, c -> struct(c.pos as pos, {', '.join(_derived(tuple(FLOORS), 'c.'))}, case when {named} then true else {bare} end as pairable))"


def _pairable(line: str) -> str:
    return f"coalesce({', '.join(f'{line}.{_named(c)}' for c in PAIRING_CELLS)}) is not null"


def pairable() -> Column:
    return F.coalesce(*[F.col(_named(c)) for c in PAIRING_CELLS]).isNotNull()


def named() -> Column:
    return F.coalesce(F.col("code"), F.col("description")).isNotNull()


def signature() -> Column:
    """A line as pairing sees it: its pairing cells' comparable values. Equal ones can't be told apart."""
    values = lambda c: F.array_sort(F.array_distinct(F.zip_with(_named(c), f"{_named(c)}_n", lambda t, n: F.coalesce(n.cast("string"), normalize.text(t)))))
    return F.struct(*[F.col(f"{c}_t").alias(c) for c in ("code", "description")], *[values(c).alias(_named(c)) for c in VALUE_CELLS])


# --- pairing ---------------------------------------------------------------------------------------

def _best_of(one: str, other: str, measure: str) -> str:
    """The greatest measure (of x and y) of any of one's values with any of the other's; null where a side has none."""
    return f"array_max(flatten(transform({one}, x -> transform({other}, y -> {measure}))))"


def _similar(x: str, y: str) -> str:
    return f"(1 - levenshtein({x}, {y}) / greatest(length({x}), length({y})))"


def _nearness(x: str, y: str) -> str:
    """Smaller over larger magnitude in thousandths, half up: 0 for opposite signs, 1000 for two zeros."""
    low, high = (f"cast({f}(abs({x}), abs({y})) as double)" for f in ("least", "greatest"))
    return f"cast(case when {x} = 0 and {y} = 0 then 1000 when ({x} < 0) <> ({y} < 0) then 0 else floor({low} * 1000 / {high} + 0.5) end as bigint)"


def _single(a: str, b: str) -> str:
    return f"size({a}) = 1 and size({b}) = 1"


def _alike(cell: str) -> str:
    a, b = f"a.{cell}_t", f"b.{cell}_t"
    return f"case when {_single(a, b)} then {_similar(f'{a}[0]', f'{b}[0]')} when {a} is not null and {b} is not null then {_best_of(a, b, _similar('x', 'y'))} end"


def _close(cell: str) -> str:
    a, b = f"a.{_named(cell)}_n", f"b.{_named(cell)}_n"
    whole = lambda x: f"filter({x}, v -> v is not null)"
    return f"coalesce(case when {_single(a, b)} then {_nearness(f'{a}[0]', f'{b}[0]')} else {_best_of(whole(a), whole(b), _nearness('x', 'y'))} end, 0L)"


def _agree(cell: str) -> str:
    """Whether two sides share a value of a cell, as it is compared: as a number, or where it reads as none as text."""
    side = lambda s: f"zip_with({s}.{_named(cell)}, {s}.{_named(cell)}_n, (t, n) -> coalesce(cast(n as string), {_text_sql('t')}))"
    return f"cast(coalesce(arrays_overlap({side('a')}, {side('b')}), false) as bigint)"


def _graded(code: str, description: str) -> str:
    """Identity: the similarity of code and of description, each in thousandths if it reaches its floor."""
    return " + ".join(f"case when {c} >= {FLOORS[n]}D then cast(bround({c} * 1000) as bigint) else 0L end" for n, c in (("code", code), ("description", description)))


def _values() -> str:
    """Closeness of quantity, unit price and amount, and equal units, of lines a and b: only breaks ties."""
    return f"{' + '.join(map(_close, VALUE_CELLS))} + case when size(a.unit_t) > 0 and a.unit_t = b.unit_t then 1000 else 0 end"


def _deciding(e: str) -> str:
    """Identity, or where neither line has a code or description the number of values that agree exactly."""
    return f"case when {_graded(f'{e}.code', f'{e}.description')} > 0 then {_graded(f'{e}.code', f'{e}.description')} else {e}.agreements end"


def _met(right: str) -> str:
    """Line a against each of the right lines, as SQL: their places, similarities, values and what decides."""
    nameless = "coalesce(a.code, a.description, b.code, b.description) is null"
    met = (
        f"transform({right}, b -> struct(a.pos as left, b.pos as right, {_alike('code')} as code, {_alike('description')} as description, {_values()} as values, "
        f"case when {nameless} then {' + '.join(map(_agree, VALUE_CELLS))} else 0L end as agreements))"
    )
    return f"transform({met}, e -> struct(e.left as left, e.right as right, e.code as code, e.description as description, e.values as values, {_deciding('e')} as deciding))"


@F.pandas_udf(ArrayType(IntegerType()))
def chosen(edges: pd.Series) -> pd.Series:
    """Of each case's edges (left, right and worth of each, as one text), the places of those in its best assignment; null for cases without."""

    def of(listed):  # noqa: ANN001, ANN202
        if listed is None:
            return None
        lefts, rights, worths = ([int(e.split(",")[k]) for e in listed.split(";") if e] for k in range(3))
        at = {pair: k for k, pair in enumerate(zip(lefts, rights, strict=True))}
        return [at[i, j] for i, j, _ in assignment._solve(lefts, rights, worths)]

    return edges.map(of).astype(object)


def _let(value: str, name: str, body: str) -> str:
    """SQL in which a value is worked out once and goes by a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _best(worth: str) -> str:
    """`assignment.best` of a matrix with no more rows than columns, as SQL: of each column its row, or -1."""
    far = "4611686018427387903L"
    reach = "transform(t.dist, (x, j) -> t.short + w.top - w.m[t.at][j] - s.u[t.at] - s.v[j])"
    better = "not t.done[j] and reach[j] < t.dist[j]"
    near = f"named_struct('dist', transform(t.dist, (x, j) -> case when {better} then reach[j] else x end), 'parent', transform(t.parent, (x, j) -> case when {better} then t.col else x end))"
    ahead = f"transform(n.dist, (x, j) -> case when t.done[j] then {far} else x end)"
    step = (
        "named_struct('at', case when s.r[c] < 0 then t.at else s.r[c] end, 'col', c, 'short', n.dist[c], 'dist', n.dist, 'parent', n.parent, "
        "'done', transform(t.done, (x, j) -> x or j = c), 'over', s.r[c] < 0)"
    )
    step = _let(reach, "reach", _let(near, "n", _let(ahead, "ahead", _let("array_position(ahead, array_min(ahead)) - 1L", "c", step))))
    start = f"named_struct('at', i, 'col', -1L, 'short', 0L, 'dist', transform(s.v, x -> {far}), 'parent', transform(s.v, x -> -1L), 'done', transform(s.v, x -> false), 'over', false)"
    found = f"aggregate(sequence(0L, i), {start}, (t, q) -> case when t.over then t else {step} end)"
    raised = _let("array_position(s.r, cast(k as bigint)) - 1L", "c", "case when c < 0 then x when f.done[c] and c <> f.col then x + f.short - f.dist[c] else x end")
    turned = _let("f.parent[g.col]", "b", "named_struct('r', transform(g.r, (x, j) -> case when j = g.col then case when b < 0 then i else g.r[b] end else x end), 'col', b, 'over', b < 0)")
    after = (
        f"named_struct('u', transform(s.u, (x, k) -> case when k = i then x + f.short else {raised} end), 'v', transform(s.v, (x, j) -> case when f.done[j] then x - f.short + f.dist[j] else x end), "
        f"'r', aggregate(sequence(0L, i), named_struct('r', s.r, 'col', f.col, 'over', false), (g, q) -> case when g.over then g else {turned} end).r)"
    )
    none = "named_struct('u', transform(w.m, x -> 0L), 'v', transform(w.m[0], x -> 0L), 'r', transform(w.m[0], x -> -1L))"
    rows = f"aggregate(sequence(0L, size(w.m) - 1L), {none}, (s, i) -> {_let(found, 'f', after)}).r"
    return _let(f"named_struct('m', {worth}, 'top', array_max(flatten({worth})))", "w", rows)


def assigned(edges: str) -> str:
    """`assignment._solve` of an array of structs with left, right and worth, as SQL: the structs of its best pairs."""
    mine = "array_distinct(transform(filter(es, e -> e.a = l), e -> e.b))"
    met = lambda c: f"transform(filter(acc, c -> arrays_overlap(c.bs, mine)), c -> c.{c})"
    joined = f"array(struct(flatten(concat({met('as')}, array(array(l)))) as as, array_distinct(flatten(concat({met('bs')}, array(mine)))) as bs))"
    merged = _let(mine, "mine", f"concat(filter(acc, c -> not arrays_overlap(c.bs, mine)), {joined})")
    parts = f"aggregate(array_distinct(transform(es, e -> e.a)), cast(array() as array<struct<as:array<bigint>,bs:array<bigint>>>), (acc, l) -> {merged})"
    alone = "transform(array(array_max(transform(own, e -> struct(e.w as w, -e.a as a, -e.b as b)))), e -> struct(-e.a as a, -e.b as b))"
    # The shorter side is met as rows: `x` and `y` of an edge.
    turned = "array_sort(transform(own, e -> case when size(p.as) > size(p.bs) then struct(e.b as x, -e.w as w, e.a as y) else struct(e.a as x, -e.w as w, e.b as y) end))"
    sides = "case when size(p.as) > size(p.bs) then struct(array_sort(p.bs) as xs, array_sort(p.as) as ys) else struct(array_sort(p.as) as xs, array_sort(p.bs) as ys) end"
    row = _let("filter(es, e -> e.x = x)", "own", _let("transform(own, e -> e.y)", "at", "transform(d.ys, y -> coalesce(-get(own, cast(array_position(at, y) as int) - 1).w, 0L))"))
    matrix = _let(turned, "es", f"transform(d.xs, x -> {row})")
    picked = "filter(transform(r, (k, j) -> case when k >= 0 then case when m[k][j] > 0 then case when size(p.as) > size(p.bs) then struct(d.ys[j] as a, d.xs[k] as b) else struct(d.xs[k] as a, d.ys[j] as b) end end end), e -> e is not null)"
    dense = _let(sides, "d", _let(matrix, "m", _let(_best("m"), "r", picked)))
    of = _let("filter(es, e -> array_contains(p.as, e.a))", "own", f"case when size(p.as) = 1 or size(p.bs) = 1 then {alone} else {dense} end")
    pairs = _let(f"transform({edges}, e -> struct(e.left as a, e.right as b, e.worth as w))", "es", f"flatten(transform({parts}, p -> {of}))")
    return f"transform({pairs}, m -> element_at(filter({edges}, e -> e.left = m.a and e.right = m.b), -1))"


# What a line is known by, if it has exactly one text of each name it has, and of which kind that is.
_KIND = "concat(" + ", ".join(f"case when x.{c}_t is null then '-' when size(x.{c}_t) = 1 and length(x.{c}_t[0]) <= 1000 then '1' else '?' end" for c in FLOORS) + ")"
_KEY = "concat(coalesce(concat(length(x.code_t[0]), ':', x.code_t[0]), ''), '|', coalesce(x.description_t[0], ''))"


def once(value: Column) -> Column:
    """A value that is worked out once a row: what counts as not deterministic is neither repeated
    nor moved into a lambda or a filter by the optimizer."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def with_(df: DataFrame, **columns: str) -> DataFrame:
    return df.select("*", *[once(F.expr(sql)).alias(name) for name, sql in columns.items()])


def _paired(cases: DataFrame, candidates: bool) -> DataFrame:
    """`_paired_by` of cases: rows that wait for Python carry their lines and go to disk, so only cases of many lines do."""
    many = f"size(_a) > {MANY} and size(_b) > {MANY}"
    return _paired_by(cases.where(f"not ({many})"), candidates, False).unionByName(_paired_by(cases.where(many), candidates, True))


def _paired_by(cases: DataFrame, candidates: bool, python: bool) -> DataFrame:
    """`cases` (with `_a` and `_b`, the lines of either side) with `_fa`, `_fb`, their places and whether they are pairable, and `_pairs`: left, right, code, description.
    If candidates are asked for, `_ca` and `_cb` are the lines' cells where a line may be in no pair, else null.

    Where all lines carry the same names, each once and no two of a side alike, a line that has its
    equal on the other side reaches the most that any pair with it could, and only with that equal
    (texts of up to 1,000 signs, so one edit shows in the thousandths). So the equals are the best
    assignment, and the only one, if one side has nothing but equals, or if no line without an equal
    reaches a floor with any line: an assignment that is better must begin or end at such a line.
    Only lines without an equal need comparing then. Everywhere else all lines are compared.
    """
    of = lambda side: f"filter(_n{side}, x -> x.pairable)"
    df = with_(cases, _na=_name_list("_a"), _nb=_name_list("_b"))
    df = with_(df, _pa=of("a"), _pb=of("b"))
    df = with_(df, _ka=f"transform(_pa, x -> {_KEY})", _kb=f"transform(_pb, x -> {_KEY})", _kinds=f"array_distinct(transform(concat(_pa, _pb), x -> {_KIND}))")
    plain = "size(_kinds) = 1 and _kinds[0] in ('1-', '-1', '11') and size(array_distinct(_ka)) = size(_ka) and size(array_distinct(_kb)) = size(_kb)"
    rest = lambda s, o: f"filter(_p{s}, (x, k) -> not array_contains(_k{o}, _k{s}[k]))"
    df = with_(df, _plain=plain, _ra=rest("a", "b"), _rb=rest("b", "a"))
    reaches = f"coalesce({_alike('code')} >= {FLOORS['code']}D, false) or coalesce({_alike('description')} >= {FLOORS['description']}D, false)"
    lone = f"size(_ra) = 0 or size(_rb) = 0 or not (exists(_ra, a -> exists(_pb, b -> {reaches})) or exists(_rb, b -> exists(_pa, a -> {reaches})))"
    df = with_(df, _equal=f"size(_pa) = 0 or size(_pb) = 0 or (_plain and ({lone}))")
    listing = lambda asked: {f"_c{side}": f"case when {asked} then {_cell_list(f'_{side}', 'pos')} end" for side in "ab"}
    df = with_(df, **listing("not _equal"))
    scale = "(4000L * least(size(_pa), size(_pb)) + 1)"
    full = lambda side: f"filter(_c{side}, x -> {_pairable('x')})"
    edges = f"flatten(transform({full('a')}, a -> transform(filter({_met(full('b'))}, e -> e.deciding > 0), e -> struct(e.left as left, e.right as right, e.code as code, e.description as description, e.deciding * {scale} + e.values as worth))))"
    df = with_(df, _edges=f"case when not _equal then {edges} end")
    same = "named_struct('left', a.pos, 'right', _pb[cast(array_position(_kb, _ka[k]) as int) - 1].pos, 'code', case when a.code_t is not null then 1D end, 'description', case when a.description_t is not null then 1D end)"
    equals = f"transform(filter(transform(_pa, (a, k) -> case when array_contains(_kb, _ka[k]) then {same} end), m -> m is not null), m -> m)"
    nothing = "cast(array() as array<struct<left:bigint,right:bigint,code:double,description:double>>)"
    listed = lambda side: f"transform(_n{side}, x -> struct(x.pos as pos, x.pairable as pairable))"
    # Rows wait for Python in a queue that may go to disk: they carry no more than is read after it, and one flat column of edges, which most cases do not have.
    df = with_(df, _equals=f"case when size(_pa) = 0 or size(_pb) = 0 then {nothing} when _equal then {equals} end", _fa=listed("a"), _fb=listed("b"), _free="not _equal or size(_ra) > 0 or size(_rb) > 0")
    df = df.select("case_id", "_a", "_b", "_r", "_fa", "_fb", "_free", "_equals", "_edges")
    pair = lambda e: f"struct({e}.left as left, {e}.right as right, {e}.code as code, {e}.description as description)"
    if python:
        df = df.withColumn("_chosen", chosen(F.expr("array_join(transform(_edges, e -> concat(e.left, ',', e.right, ',', e.worth)), ';')")))
        solved = f"transform(_chosen, k -> {pair('_edges[k]')})"
    else:
        solved = f"transform({assigned('_edges')}, e -> {pair('e')})"
    df = with_(df, _pairs=f"coalesce(_equals, {solved})")
    if candidates:
        df = with_(df, **listing("_free"))
    return df.drop("_free", "_equals", "_edges", "_chosen")


_CANDIDATE = "struct<line:bigint,code:double,description:double,reason:string>"


def _candidate(line: str, right: str, taken: str, other: str) -> str:
    """The closest of the other side's lines - similarity first, then closeness, then place - with the
    reason it was not taken; null without any. `line` is the name that `_met` knows the line by."""
    met = _met(right) if line == "a" else f"flatten(transform({right}, a -> {_met('array(b)')}))"
    ranked = f"transform({met}, e -> struct(coalesce(e.code, 0D) + coalesce(e.description, 0D) as alike, e.values as values, -e.{other} as first, e.{other} as line, e.code as code, e.description as description, e.deciding as deciding))"
    reason = f"case when array_contains({taken}, w.line) and w.deciding > 0 then 'taken by another line' when coalesce(w.code, w.description) is not null then 'below the floor' else 'no agreement' end"
    return f"transform(array(array_max({ranked})), w -> case when w is not null then cast(struct(w.line, w.code, w.description, {reason}) as {_CANDIDATE}) end)[0]"


# --- rules -----------------------------------------------------------------------------------------

FINDING = (
    "ord array<bigint>, type string, severity string, place_kind string, place_line bigint, cell string, invoice array<string>, purchase_order array<string>, receipt array<string>, "
    "lowest decimal(28,8), margin decimal(32,10), percent string, cent string, candidate struct<line:bigint,code:double,description:double,reason:string>"
)
NOT_COMPARED = "ord array<bigint>, place_kind string, place_line bigint, cell string, texts array<string>, reason string"


def _typed(fields: str) -> str:
    return f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>"


_NONE = "cast(array() as array<string>)"
_NOTHING, _CLEAR = (f"cast(array() as array<{_typed(x)}>)" for x in (NOT_COMPARED, FINDING))


def _ord(parts: tuple) -> str:
    return f"array({', '.join(f'cast({x} as bigint)' for x in parts)})"


def _finding(kind: str, ord_: tuple, place: tuple[str, str], cell: str | None, invoice: str = _NONE, ordered: str = _NONE, received: str = _NONE, lowest: str | None = None, tolerance: Tolerance | None = None, candidate: str = "null") -> str:
    text = lambda x: "null" if x is None else f"'{x}'"
    margin = tolerance.margin(lowest) if tolerance and lowest else "null"
    percent, cent = (text(tolerance.percent), text(tolerance.cent)) if tolerance else ("null", "null")
    return f"cast(struct({_ord(ord_)}, '{kind}', '{SEVERITY[kind]}', '{place[0]}', {place[1]}, {text(cell)}, {invoice}, {ordered}, {received}, {lowest or 'null'}, {margin}, {percent}, {cent}, {candidate}) as {_typed(FINDING)})"


class Side(NamedTuple):
    """One side's cell, as SQL: its texts and their numbers."""

    texts: str
    numbers: str | None = None

    @property
    def carried(self) -> str:
        return f"{self.texts} is not null"

    @property
    def read(self) -> str:
        return f"({self.carried} and case when size({self.numbers}) = 1 then {self.numbers}[0] is not null else not exists({self.numbers}, x -> x is null) end)"


def _every(conditions: list[str]) -> str:
    return f"({' and '.join(conditions)})"


def _entry(ord_: tuple, place: tuple[str, str], cell: str | None, texts: str, reason: str) -> str:
    shown = "null" if cell is None else f"'{cell}'"
    return f"cast(struct({_ord(ord_)}, '{place[0]}', {place[1]}, {shown}, {texts}, '{reason}') as {_typed(NOT_COMPARED)})"


def _missed(ord_: tuple, place: tuple[str, str], cell: str, sides: list[Side]) -> str:
    """What kept sides from being compared: each carried one as absent where another lacks the cell, else each that does not read."""
    every = _every([s.carried for s in sides])
    absent = [f"case when not {every} and {s.carried} then {_entry((*ord_, i), place, cell, s.texts, 'absent')} end" for i, s in enumerate(sides)]
    unread = [f"case when {every} and not {s.read} then {_entry((*ord_, i), place, cell, s.texts, 'unreadable')} end" for i, s in enumerate(sides) if s.numbers]
    whole = _every([s.read if s.numbers else s.carried for s in sides])
    return f"case when {whole} then {_NOTHING} else array_compact(array({', '.join(absent + unread)})) end"


def _comparable(sides: list[Side]) -> str:
    return _every([s.read for s in sides])


def _above(side: Side, against: Side, tolerance: Tolerance) -> str:
    """Whether the highest of a side is over the lowest of the other; the same numbers on both agree."""
    same = f"case when {_single(side.numbers, against.numbers)} then {side.numbers}[0] = {against.numbers}[0] else array_sort(array_distinct({side.numbers})) = array_sort(array_distinct({against.numbers})) end"
    return f"coalesce(not ({same}) and {tolerance.exceeded(f'array_max({side.numbers})', f'array_min({against.numbers})')}, false)"


def _pair_rules() -> tuple[dict[str, str], str, str]:
    """The findings price, shipment and order can give, and of these columns findings and missed of a pairing, as SQL: the unit, and where it agrees price and quantities."""
    side = lambda s, c: Side(f"{s}_{_named(c)}", f"{s}_{_named(c)}_n" if c in VALUE_CELLS else None)
    place = ("po line", "po_line")
    at = lambda *step: (1, "invoice_line", *step)
    unit = [side("i", "unit"), side("p", "unit")]
    other_unit = f"coalesce({_every([s.carried for s in unit])} and i_unit_t <> p_unit_t, false)"
    variant = _finding("unit variant", at(0), place, "unit", unit[0].texts, unit[1].texts, tolerance=EXACT)
    held_back = [f"case when {side('i', c).carried} then {_entry(at(1, k), place, c, side('i', c).texts, 'unit variant')} end" for k, c in enumerate((*PRICE_CELLS, "quantity"))]

    price, amount = ([side("i", c), side("p", c)] for c in PRICE_CELLS)
    over = lambda c, s: f"case when {_above(s[0], s[1], MONEY)} then {_finding('price variance', at(2), place, c, s[0].texts, s[1].texts, lowest=f'array_min({s[1].numbers})', tolerance=MONEY)} end"
    price_finding = f"case when {_comparable(price)} then {over('unit price', price)} when {_comparable(amount)} then {over('amount', amount)} end"
    price_missed = f"concat({_missed(at(2), place, 'unit price', price)}, case when {_comparable(price)} then {_NOTHING} else {_missed(at(3), place, 'amount', amount)} end)"

    billed, shipped, ordered = side("i", "quantity"), side("r", "quantity"), side("p", "quantity")
    two, three = _comparable([billed, shipped]), _comparable([billed, shipped, ordered])
    short = f"case when received and {two} and {_above(billed, shipped, EXACT)} then {_finding('short-ship', at(4), place, 'quantity', billed.texts, received=shipped.texts, lowest=f'array_min({shipped.numbers})', tolerance=EXACT)} end"
    over_ship = (
        f"case when received and {three} and {_above(billed, ordered, EXACT)} and {_above(shipped, ordered, EXACT)} "
        f"then {_finding('over-ship', at(5), place, 'quantity', billed.texts, ordered.texts, shipped.texts, f'array_min({ordered.numbers})', EXACT)} end"
    )
    both = _every([billed.carried, shipped.carried])
    order_alone = (
        f"array_compact(array(case when {ordered.carried} and not {both} then {_entry(at(4, 9), place, 'quantity', ordered.texts, 'absent')} "
        f"when {ordered.carried} and {both} and not {ordered.read} then {_entry(at(4, 9), place, 'quantity', ordered.texts, 'unreadable')} end))"
    )
    quantity_missed = f"case when not received then {_NOTHING} when {two} then {_missed(at(5), place, 'quantity', [billed, shipped, ordered])} else concat({_missed(at(4), place, 'quantity', [billed, shipped])}, {order_alone}) end"

    single = {"_priced": price_finding, "_short": short, "_over": over_ship}
    findings = f"case when {other_unit} then array({variant}) when coalesce({', '.join(single)}) is null then {_CLEAR} else array_compact(array({', '.join(single)})) end"
    missed = f"concat({_missed(at(0), place, 'unit', unit)}, case when {other_unit} then array_compact(array({', '.join(held_back)})) else concat({price_missed}, {quantity_missed}) end)"
    return single, findings, missed


class Match(NamedTuple):
    """The result of a match: a table each of pairings, findings, what was not compared, and verdicts.
    `ord` orders the findings and entries of a case as a report lists them. `lines` has a row for each
    pair and each line that is in none: case_id, invoice_line, po_line, received, findings, missed."""

    pairings: DataFrame
    findings: DataFrame
    not_compared: DataFrame
    verdicts: DataFrame
    lines: DataFrame


def match(invoice: DataFrame, ordered: DataFrame, received: DataFrame, headers: DataFrame) -> Match:
    """Cases matched three ways.

    `invoice` and `ordered` have case_id, pos, fields; `received` case_id, po_line, fields, at most
    one row for a purchase-order line (a second raises an error when the result is read); `headers`
    one row a case with `invoice_fields` and `order_fields`. A case is one that has a header row;
    lines of other cases are not read. Lines with nothing to pair on are listed as not compared.
    Extra columns are not read. Of assignments of equal worth the one taking earlier lines is kept.
    """
    gathered = lambda df, place, name: df.groupBy("case_id").agg(F.collect_list(F.struct(place, "fields")).alias(name))
    cases = gathered(invoice, "pos", "invoice").join(gathered(ordered, "pos", "ordered"), "case_id", "full").join(gathered(received, "po_line", "received"), "case_id", "left")
    return match_cases(cases, headers)


def match_cases(cases: DataFrame, headers: DataFrame, candidates: bool = True) -> Match:
    """`match` of lines that are gathered already: `cases` has a row a case with arrays `invoice` and
    `ordered` of pos and fields, and `received` of po_line and fields. Who doesn't read the candidates
    of unpaired lines can leave them null."""
    ids = headers.select("case_id").distinct()
    some = lambda name: f"coalesce({name}, array())"
    single = "case when size(array_distinct(transform(received, x -> x.po_line))) < size(received) then raise_error('two receipt lines for one purchase-order line') else coalesce(received, array()) end as _r"
    # The ids are hashed: a join that sorts would write the cases' lines to disk.
    df = cases.join(ids.hint("shuffle_hash"), "case_id", "left_semi").selectExpr("case_id", f"{some('invoice')} as _a", f"{some('ordered')} as _b", single)
    df = _paired(df, candidates)
    pairings = df.selectExpr("case_id", "inline_outer(_pairs)").where("left is not null")

    df = with_(df, _left="transform(_pairs, m -> m.left)", _right="transform(_pairs, m -> m.right)", _at="transform(_a, x -> x.pos)", _to="transform(_b, x -> x.pos)", _got="transform(_r, x -> x.po_line)")
    at = lambda side, places, place: f"get({side}, cast(array_position({places}, {place}) as int) - 1).fields"
    none = lambda side: f"get({side}, -1).fields"
    got = lambda line: f"coalesce(array_position(_got, {line}), 0L) > 0"
    entry = lambda kind, left, right, free, received, i, p, r, candidate: f"named_struct('kind', {kind}, 'invoice_line', {left}, 'po_line', {right}, 'free', {free}, 'received', {received}, 'i', {i}, 'p', {p}, 'r', {r}, 'candidate', {candidate})"
    lone = lambda kind, left, right, received, candidate: entry(kind, left, right, "x.pairable", received, none("_a"), none("_b"), none("_r"), candidate)
    nothing, line = f"cast(null as {_CANDIDATE})", "cast(null as bigint)"
    full = lambda side: f"filter(_c{side}, y -> {_pairable('y')})"
    closest = lambda a, b, taken, other: f"case when x.pairable then transform(array(_c{a}[k]), {a} -> {_candidate(a, full(b), taken, other)})[0] end" if candidates else nothing
    unpaired = lambda side, taken, of: f"filter(transform(_f{side}, (x, k) -> case when not array_contains({taken}, x.pos) then {of} end), e -> e is not null)"
    entries = (
        f"concat(transform(_pairs, m -> {entry('0', 'm.left', 'm.right', 'false', got('m.right'), at('_a', '_at', 'm.left'), at('_b', '_to', 'm.right'), at('_r', '_got', 'm.right'), nothing)}), "
        f"{unpaired('a', '_left', lone('1', 'x.pos', line, 'false', closest('a', 'b', '_right', 'right')))}, {unpaired('b', '_right', lone('2', line, 'x.pos', got('x.pos'), closest('b', 'a', '_left', 'left')))})"
    )
    met = df.selectExpr("case_id", f"inline_outer({entries})").where("kind is not null")
    # What the rules compare is resolved line by line: what pairing asked for besides is not read again.
    compared = ("unit", *PRICE_CELLS, "quantity")
    sides = [("i", compared), ("p", compared), ("r", ("quantity",))]
    met = with_(met, **{f"{s}_{_named(c)}": _texts(s, c) for s, names in sides for c in names})
    met = with_(met, **{f"{s}_{_named(c)}{end}": sql for s, names in sides for c in names for end, sql in _compared(c, f"{s}_{_named(c)}").items()})
    single, findings, missed = _pair_rules()
    met = with_(met, **{name: f"case when kind = 0 then {sql} end" for name, sql in single.items()})
    extra, missing = (_finding(kind, (k, at_), (place, at_), None, candidate="candidate") for kind, k, place, at_ in (("extra line", 3, "invoice line", "invoice_line"), ("missing line", 4, "po line", "po_line")))
    bare = [_entry((0, k, at_), (place, at_), None, _NONE, "nothing to pair on") for k, place, at_ in ((0, "invoice line", "invoice_line"), (1, "po line", "po_line"))]
    ruled = met.selectExpr(
        "case_id", "invoice_line", "po_line", "received",
        f"case when kind = 0 then {findings} when not free then {_CLEAR} when kind = 1 then array({extra}) else array({missing}) end as findings",
        f"case when kind = 0 then {missed} when free then {_NOTHING} when kind = 1 then array({bare[0]}) else array({bare[1]}) end as missed",
    )

    tax = headers.selectExpr("case_id", *[f"{_texts(fields, 'tax')} as {s}_tax" for s, fields in (("i", "invoice_fields"), ("p", "order_fields"))])
    tax = tax.selectExpr("*", *[f"{_numbers(f'{s}_tax')} as {s}_tax_n" for s in "ip"])
    sides, header = [Side(f"{s}_tax", f"{s}_tax_n") for s in "ip"], ("header", "null")
    over = _finding("tax mismatch", (2,), header, "tax", sides[0].texts, sides[1].texts, lowest=f"array_min({sides[1].numbers})", tolerance=MONEY)
    tax = tax.selectExpr("case_id", f"array_compact(array(case when {_comparable(sides)} and {_above(sides[0], sides[1], MONEY)} then {over} end)) as findings", f"{_missed((2,), header, 'tax', sides)} as missed")
    listed = lambda name: ruled.select("case_id", name).unionByName(tax.select("case_id", name)).selectExpr("case_id", f"inline_outer({name})").where("ord is not null")
    found = listed("findings")
    verdicts = ids.join(found.groupBy("case_id").agg(F.bool_or(F.col("severity") == "hold").alias("_held")), "case_id", "left").select("case_id", F.when(F.col("_held"), "held").otherwise("approvable").alias("verdict"))
    return Match(pairings.select("case_id", F.col("left").alias("invoice_line"), F.col("right").alias("po_line"), "code", "description"), found, listed("missed"), verdicts, ruled)


def _plain(value: Column) -> Column:
    """A decimal without zeros at its end."""
    return F.regexp_replace(value.cast("string"), r"(?:\.0*|(\.\d*[1-9])0+)$", "$1")


def explain(findings: DataFrame) -> DataFrame:
    """`findings` with `explanation`: the values and the constant applied, or for an unpaired line its closest candidate and why it was not taken."""
    quoted = lambda c: F.array_join(F.transform(c, lambda t: F.concat(F.lit('"'), t, F.lit('"'))), ", ")
    place = F.concat(F.regexp_replace("place_kind", "^po", "PO"), F.coalesce(F.concat(F.lit(" "), F.col("place_line").cast("string")), F.lit("")))
    other = F.when(F.col("type") == "extra line", "PO").otherwise("invoice")
    score = lambda c: F.concat(F.lit(c), F.coalesce(F.concat(F.lit(" "), F.format_string("%.3f", F.col(f"candidate.{c}"))), F.lit(f": no {c}")))
    why = F.when(F.col("candidate").isNull(), F.concat(F.lit("the "), other, F.lit(" has no lines"))).otherwise(
        F.concat(F.lit("closest "), other, F.lit(" line "), F.col("candidate.line").cast("string"), F.lit(", "), score("code"), F.lit(", "), score("description"), F.lit(", "), F.col("candidate.reason"))
    )
    short = F.col("type") == "short-ship"
    billed = F.concat(F.lit("invoice "), quoted(F.col("invoice")), F.when(~short & (F.size("receipt") > 0), F.concat(F.lit(" and receipt "), quoted(F.col("receipt")))).otherwise(""))
    against = F.when(short, F.concat(F.lit("receipt "), quoted(F.col("receipt")))).otherwise(F.concat(F.lit("PO "), quoted(F.col("purchase_order"))))
    percent = _plain((F.col("percent").cast("decimal(7,4)") * 100).cast("decimal(9,4)"))
    how = F.when(F.col("percent") == "0", "compared exactly").otherwise(F.concat(F.lit("margin "), _plain(F.col("margin")), F.lit(" ("), percent, F.lit(" percent of "), _plain(F.col("lowest")), F.lit(", above "), F.col("cent"), F.lit(")")))
    valued = F.concat_ws(", ", "type", place, "cell", F.concat(billed, F.lit(" vs "), against), how)
    return findings.withColumn("explanation", F.when(F.col("type").isin("extra line", "missing line"), F.concat_ws(", ", "type", place, why)).otherwise(valued))


def line_ledger(result: Match) -> DataFrame:
    """`ledger` of the lines that were matched, without meeting them again."""
    return result.lines.selectExpr("case_id", "po_line", "invoice_line", "received", "array_sort(transform(findings, f -> f.type)) as types")


def ledger(ordered: DataFrame, invoice: DataFrame, received: DataFrame, result: Match) -> DataFrame:
    """One row a purchase-order line, beside the invoice line paired with it, its receipt and the
    types found there, then the invoice lines paired with none: case_id, po_line, invoice_line,
    received, types."""
    types = result.findings.where("place_line is not null").groupBy("case_id", "place_kind", "place_line").agg(F.array_sort(F.collect_list("type")).alias("types"))
    of = lambda kind, column: types.where(F.col("place_kind") == kind).select("case_id", F.col("place_line").alias(column), "types")
    lines = (
        ordered.select("case_id", F.col("pos").alias("po_line")).join(result.pairings.select("case_id", "po_line", "invoice_line"), ["case_id", "po_line"], "left")
        .join(received.select("case_id", "po_line", F.lit(True).alias("received")), ["case_id", "po_line"], "left").join(of("po line", "po_line"), ["case_id", "po_line"], "left")
        .select("case_id", "po_line", "invoice_line", F.coalesce("received", F.lit(False)).alias("received"), "types")
    )
    free = invoice.select("case_id", F.col("pos").alias("invoice_line")).join(result.pairings.select("case_id", "invoice_line"), ["case_id", "invoice_line"], "left_anti")
    rest = free.join(of("invoice line", "invoice_line"), ["case_id", "invoice_line"], "left").select("case_id", F.lit(None).cast("long").alias("po_line"), "invoice_line", F.lit(False).alias("received"), "types")
    return lines.unionByName(rest).withColumn("types", F.coalesce("types", F.array().cast("array<string>")))
