"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, natively.

A text's paragraphs are its lines, cut further after ``.``, ``!`` and ``?`` before white space. The fingerprint is a
sketch of the set of their 64-bit digests: three subtables of ``CELLS`` cells, each with a count, the exclusive or of the
digests that hash to it, and that of their checks. Sketches of two versions subtract cell by cell; a cell whose count is
1 or -1 and whose check fits holds a digest of one version only, and removing it from its other cells may free more.

If cells are left, the sketch was too small. The variance of its counts tells about how many digests differ, and by that
number, not by the texts' size, a larger one is made: both sets are dealt out by the digests' bits into parts of about
``LOAD`` differences, with a sketch of three subtables of ``PART`` cells each. A part's subtables are made one after the
other: as soon as all cells of one are empty or hold one digest, its differences are known. Else all three are peeled.
A part that is stuck even so is sketched again with four times as many cells, under other hashes, until it peels.

Likeness is the Jaccard similarity of the two digest sets, from the recovered differences; two texts without paragraphs
are alike.
"""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS, LOAD, PART, RETRIES = 8, 1, 4, 9
RANGES_PER_TASK, MOST_RANGES = 8, 100_000
LEAST = -(2**63)
_NONE = "cast(array() as array<bigint>)"


def _let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraphs(text: str) -> str:
    """SQL: the distinct digests of a text's paragraphs."""
    return f"transform(array_remove(array_distinct(split({text}, '\\\\n+|(?<=[.!?])\\\\s+')), ''), u -> xxhash64(u))"


def sketch(digests: str, width: int) -> str:
    """SQL: the 3 * width cells of a set of digests; ``digests`` must be a column or a lambda's variable."""
    cell = "aggregate(filter({d}, d -> d & {mask}L = c), named_struct('n', 0, 'k', 0L, 'h', 0L), (a, d) -> named_struct('n', a.n + 1, 'k', a.k ^ d, 'h', a.h ^ xxhash64(d)))"
    tables = (f"transform({_cells(width, 6 * j)}, c -> {cell.replace('{d}', digests).replace('{mask}', str((width - 1) << 6 * j))})" for j in range(3))
    return f"concat({', '.join(tables)})"


def _cells(width: int, shift: int) -> str:
    """SQL: the values that a digest's bits from ``shift`` have in each of ``width`` cells."""
    return f"array({', '.join(f'{c << shift}L' for c in range(width))})"


def subtract(one: str, two: str) -> str:
    return f"zip_with({one}, {two}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells: str, places: str, steps: str) -> str:
    """SQL: struct(c, a, b, go): the cells that are left, and the digests recovered for either side.

    ``places`` gives the three cells of the digest ``p.k``.
    """
    taken = f"""if(p is null, named_struct('c', s.c, 'a', s.a, 'b', s.b, 'go', false), named_struct(
        'c', {_let('at', places, "transform(s.c, (x, q) -> if(array_contains(at, q), named_struct('n', x.n - p.n, 'k', x.k ^ p.k, 'h', x.h ^ p.h), x))")},
        'a', if(p.n = 1, concat(s.a, array(p.k)), s.a), 'b', if(p.n = -1, concat(s.b, array(p.k)), s.b), 'go', true))"""
    pure = "get(filter(s.c, x -> abs(x.n) = 1 and x.h = xxhash64(x.k)), 0)"
    return f"aggregate(sequence(1, {steps}), named_struct('c', {cells}, 'a', {_NONE}, 'b', {_NONE}, 'go', true), (s, i) -> if(s.go, {_let('p', pure, taken)}, s))"


def _clean(state: str) -> str:
    return f"forall({state}.c, x -> x.n = 0 and x.k = 0)"


def _subtable(one: str, two: str, inside_: str, cells: str) -> str:
    """SQL: the difference of one subtable of two sets' sketches; ``inside_`` says whether the digest d is in the cell c."""
    inside = lambda s: f"filter({s}, d -> {inside_})"
    xor = lambda start, value: f"aggregate(xa, aggregate(xb, {start}, (x, d) -> x ^ {value}), (x, d) -> x ^ {value})"
    cell = f"named_struct('n', size(xa) - size(xb), 'k', {xor('0L', 'd')}, 'h', {xor('0L', 'xxhash64(d)')})"
    single = "named_struct('n', size(xa) - size(xb), 'k', if(size(xa) = 1, xa[0], xb[0]), 'h', xxhash64(if(size(xa) = 1, xa[0], xb[0])))"
    few = f"if(size(xa) + size(xb) = 0, named_struct('n', 0, 'k', 0L, 'h', 0L), if(size(xa) + size(xb) = 1, {single}, {cell}))"
    return f"transform({cells}, c -> {_let('xa', inside(one), _let('xb', inside(two), few))})"


_OPEN, _DONE = f"named_struct('ok', false, 'a', {_NONE}, 'b', {_NONE}, 'x', g.x, 'y', g.y)", "named_struct('ok', true, 'a', {a}, 'b', {b}, 'x', " + _NONE + ", 'y', " + _NONE + ")"


def _found(a: str, b: str) -> str:
    return _DONE.replace("{a}", a).replace("{b}", b)


def _parts(one: str, two: str, bits: str) -> str:
    """SQL: both sets in 2^bits parts (x, y) by the digests' bits, in two steps."""
    def split(width: str, shift: int, name: str, ones: str, twos: str, to: tuple[str, str], body: str) -> str:
        pick = lambda d: f"filter({d}, d -> d & {name}m = {name}v)"
        each = _let(f"{name}v", f"shiftleft({name}i, {shift})", _let(to[0], pick(ones), _let(to[1], pick(twos), body)))
        return _let(name, f"shiftleft(1L, cast({width} as int)) - 1", _let(f"{name}m", f"shiftleft({name}, {shift})", f"transform(sequence(0L, {name}), {name}i -> {each})"))

    inner = split(f"{bits} - ({bits} div 2)", 32, "fine", "ha", "hb", ("ga", "gb"), "named_struct('x', ga, 'y', gb)")
    return f"filter(flatten({split(f'{bits} div 2', 48, 'coarse', one, two, ('ha', 'hb'), inner)}), g -> size(g.x) + size(g.y) > 0)"


def _small(j: int) -> str:
    """SQL: subtable j of a part's sketch."""
    return _subtable("g.x", "g.y", f"d & {(PART - 1) << 10 * j}L = c", _cells(PART, 10 * j))


def _by_subtables() -> str:
    """SQL: a part's differences from the first subtable whose cells are all empty or hold one digest."""
    alone = "forall(cs, x -> if(x.n = 0, x.k = 0 and x.h = 0, abs(x.n) = 1 and x.h = xxhash64(x.k)))"
    body = _OPEN
    for j in (2, 1, 0):
        body = _let("cs", _small(j), f"if({alone}, {_found('transform(filter(cs, x -> x.n = 1), x -> x.k)', 'transform(filter(cs, x -> x.n = -1), x -> x.k)')}, {body})")
    lone = _found("g.x", "g.y")  # of one digest each cell that holds it is that digest
    return f"transform(parts, g -> if(size(g.x) + size(g.y) = 1, {lone}, {body}))"


def _by_peeling() -> str:
    """SQL: the same for parts that are open, from all three subtables."""
    index = lambda d, j: f"cast(shiftrightunsigned({d}, {10 * j}) & {PART - 1} as int)"
    cells = f"concat({', '.join(map(_small, range(3)))})"
    places = f"array({', '.join(f'{j * PART} + {index("p.k", j)}' for j in range(3))})"
    return f"transform(filter(tried, g -> not g.ok), g -> {_let('r', peel(cells, places, 'size(g.x) + size(g.y) + 1'), f'if({_clean("r")}, {_found("r.a", "r.b")}, {_OPEN})')})"


def _by_retries() -> str:
    """SQL: the same for parts that are still open; attempt t has 4^(t+1) cells a subtable, by bits of another hash."""
    index = lambda d, j: f"cast(shiftrightunsigned(xxhash64({d}, t), {20 * j}) & (w - 1) as int)"
    cells = f"concat({', '.join(_subtable('g.x', 'g.y', f'{index("d", j)} = c', 'sequence(0, w - 1)') for j in range(3))})"
    places = f"array({', '.join(f'{j} * w + {index("p.k", j)}' for j in range(3))})"
    attempt = _let("w", "cast(shiftleft(1, 2 * t + 2) as int)", _let("r", peel(cells, places, "size(g.x) + size(g.y) + 1"), f"if({_clean('r')}, {_found('r.a', 'r.b')}, e)"))
    tried = f"aggregate(sequence(1, {RETRIES}), {_OPEN}, (e, t) -> if(e.ok, e, {attempt}))"
    return f"transform(filter(peeled, g -> not g.ok), g -> {tried})"


def with_difference(df: DataFrame, one: str, two: str, one_sketch: str, two_sketch: str, out: str) -> DataFrame:
    """df with ``out``, struct(a, b): the digests only in the first and only in the second of two columns of sets.

    The steps are columns of their own: the first sketch, the parts, and what each attempt finds.
    """
    # a cell's count is a sum of signs: its variance is the number of differences in a cell
    squares = f"aggregate({subtract(one_sketch, two_sketch)}, 0D, (x, y) -> x + y.n * y.n) / 3 - pow(size({one}) - size({two}), 2) / {CELLS}"
    about = f"least(size({one}) + size({two}), greatest({squares}, abs(size({one}) - size({two})), {CELLS}))"
    places = f"array({', '.join(f'{CELLS * j} + cast(shiftrightunsigned(p.k, {6 * j}) & {CELLS - 1} as int)' for j in range(3))})"
    kept = df.columns
    # many times more differences than cells can't peel: then the first sketch gives their number only
    none = f"named_struct('c', {subtract(one_sketch, two_sketch)}, 'a', {_NONE}, 'b', {_NONE}, 'go', false)"
    step = df.select(*kept, F.expr(about).alias("about"))
    step = step.select(*kept, "about", F.expr(f"if(about > {6 * CELLS}, {none}, {peel(subtract(one_sketch, two_sketch), places, str(3 * CELLS))})").alias("f"))
    step = step.select(*kept, "f", F.expr(f"if({_clean('f')}, -1, cast(least(30, greatest(0, ceil(log2(about / {LOAD}D)))) as int))").alias("bits"))
    none = "cast(array() as array<struct<x: array<bigint>, y: array<bigint>>>)"
    step = step.select(*kept, "f", "bits", F.expr(f"if(bits < 0, {none}, {_parts(one, two, 'bits')})").alias("parts"))
    step = step.select(*kept, "f", "bits", F.expr(_by_subtables()).alias("tried"))
    step = step.select(*kept, "f", "bits", "tried", F.expr(_by_peeling()).alias("peeled"))
    step = step.select(*kept, "f", "bits", "tried", "peeled", F.expr(_by_retries()).alias("retried"))
    sides = {k: f"concat(if(bits < 0, f.{k}, {_NONE}), flatten(tried.{k}), flatten(peeled.{k}), flatten(retried.{k}))" for k in "ab"}
    failed = "if(exists(retried, e -> not e.ok), raise_error('two digests are alike in all hashes'), named_struct('a', {a}, 'b', {b}))"
    return step.select(*kept, F.expr(failed.replace("{a}", sides["a"]).replace("{b}", sides["b"])).alias(out))


def likeness(diff: str, one: str, two: str) -> str:
    """SQL: common digests over all digests."""
    return f"if(size({one}) + size({two}) = 0, 1.0D, (size({one}) - size({diff}.a)) / cast(size({one}) + size({diff}.b) as double))"


def printed(cells: str) -> str:
    """SQL: a sketch as text, without the line breaks that some sessions put in."""
    return f"translate(base64(unhex(array_join(transform({cells}, x -> concat(lpad(hex(x.n), 4, '0'), lpad(hex(x.k), 16, '0'), lpad(hex(x.h), 16, '0'))), ''))), '\\r\\n', '')"


def _below(bounds: F.Column, n: int, key: F.Column, closed: bool) -> F.Column:
    """How many of n sorted bounds are less than the key (``closed``: or equal), by a list of every so manieth first."""
    step = max(1, ceil(sqrt(n)))
    under = lambda b: b <= key if closed else b < key
    coarse = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.lit(n), F.lit(step)), lambda i: F.element_at(bounds, i)), under))
    start = F.greatest(coarse - 1, F.lit(0)) * step
    return start + F.size(F.filter(F.slice(bounds, start + 1, F.lit(step)), under))


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, digests, cells (their sketch), and those of the next document by descending id (next, next_digests,
    next_cells); after the last, the first. Equal ids follow each other by descending text hash.

    The rows are dealt out by ranges of ids, at quantiles; an id that takes up several quantiles is cut further by text
    hash. The last row of a range finds its successor in a row that is appended to the range: the first row of the next
    one, of which there are as many as ranges.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST))
    rows = docs.select(key.alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    n = min(MOST_RANGES, RANGES_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(rows.agg(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], max(10_000, 4 * n)).alias("c")).first().c or [])
    if cuts:
        bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")
        low, high = (_below(bounds, len(cuts), F.col("id"), closed) for closed in (False, True))
        inside = F.floor((F.shiftrightunsigned(F.col("hash").bitwiseXOR(F.lit(LEAST)), 32) * (high - low + 1)) / 2.0**32)
        rows = rows.withColumn("range", (low + F.when(high > low, F.least(inside, high - low)).otherwise(0)).cast("int"))
    else:
        rows = rows.withColumn("range", F.lit(0))
    rows = rows.select("range", "id", "hash", "text")
    heads = rows.groupBy("range").agg(F.max(F.struct("id", "hash")).alias("head"))
    down = Window.orderBy(F.desc("range"))
    after = heads.select("range", F.coalesce(F.lead("head").over(down), F.first("head").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("next"))
    after = after.select("range", F.col("next.id").alias("id"), F.col("next.hash").alias("hash"))
    tails = rows.select("id", "hash", "text").join(F.broadcast(after), ["id", "hash"]).groupBy("range").agg(F.max("text").alias("text"))
    both = rows.withColumn("tail", F.lit(0)).unionByName(tails.select("range", F.lit(LEAST).alias("id"), F.lit(LEAST).alias("hash"), "text", F.lit(1).alias("tail")))
    order = Window.partitionBy("range").orderBy("tail", F.desc("id"), F.desc("hash"), F.desc("text"))
    both = both.withColumn("digests", F.expr(paragraphs("text")))
    both = both.withColumn("cells", F.expr(_let("v", "digests", sketch("v", CELLS))))
    return both.select("id", "text", "digests", "cells", "tail", *(F.lead(c).over(order).alias(n) for c, n in (("text", "next"), ("digests", "next_digests"), ("cells", "next_cells")))).filter("tail = 0").drop("tail")


def versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited version, whose last third gives way to the next text's start.

    Null texts count as empty; a null id comes last in descending order and comes back as null; rows of equal ids follow
    each other by descending text hash; a single row is its own successor; an empty table gives no rows. Other columns are
    ignored. Besides the digests' sets the differences are returned: ``gone`` and ``new`` paragraph digests.
    """
    base = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    base = base.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - cut), F.substr("next", F.lit(1), cut)))
    made = base.select("id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digests", "cells", "next_digests", "next_cells", F.expr(paragraphs("edited")).alias("edited_digests"))
    made = made.withColumn("edited_cells", F.expr(_let("v", "edited_digests", sketch("v", CELLS))))
    made = with_difference(made, "digests", "edited_digests", "cells", "edited_cells", "changed")
    made = with_difference(made, "digests", "next_digests", "cells", "next_cells", "other")
    return made.select(
        F.when(F.col("id") != LEAST, F.col("id")).alias("doc_id"),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        F.expr(printed("cells")).alias("fingerprint"),
        F.expr(printed("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("changed", "digests", "edited_digests")).alias("near_edited"),
        F.expr(likeness("other", "digests", "next_digests")).alias("near_next"),
        F.col("changed.a").alias("gone"),
        F.col("changed.b").alias("new"),
    )
