"""Homomorphic multiset fingerprints of documents, DataFrame functions only.

A paragraph (text between newlines) is hashed to a wide vector and a text's
fingerprint is the sum of its paragraphs' vectors, component by component,
modulo powers of two. So texts with the same paragraphs in any order are equal,
and paragraphs are put in or taken out by adding or subtracting their vectors,
without the rest of the text. A vector has three parts:

* the number of paragraphs, modulo 2^32;
* `LANES` dense components modulo 2^60, 15 hex digits each from SHA-256 of the
  numbered paragraph: equality;
* `LEVELS` x `CELLS` cells modulo 2^16. A paragraph adds a value that is not 0
  to one cell; level j takes one paragraph in 2^(j+1). In the difference of two
  fingerprints common paragraphs cancel, and the cells that are not 0 tell how
  many others there are (the count of hit cells in the lowest level that is not
  crowded, and all above). This gives the likeness: common paragraphs over all.

The fingerprint needs no shuffle. `followed` hands each row the next one in the
order of ids: the rows go once to ordered buckets, cut at quantiles of the ids; a
bucket is sorted in one task (which spills), and the first row of each bucket
passes to the one before. An id that fills whole quantiles, and null ids, are
split further by the hash of the text.

Edge cases: a null text is an empty one, with no paragraphs; a text of one
newline has two empty paragraphs, which count; two texts without paragraphs are
alike (1.0). Rows sharing an id (or without one, which come last) follow one
another by hash of the text, then text; equal rows come one after the other. The
only row of a table follows itself; an empty table gives an empty result. Ids must
be numbers. Extra columns are not read.
"""
from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import read

LANES, LEVELS, CELLS = 16, 8, 32
MASK, CELL_MASK, COUNT_MASK = (1 << 60) - 1, (1 << 16) - 1, (1 << 32) - 1
CROWDED = CELLS * 3 // 4


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _number(digits: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(digits, start, n), 16, 10).cast("long")


def _vector(digests: Column) -> Column:
    """Dense components, cell and value of a paragraph from its four digests."""
    m = _number(digests[2], 61, 4).bitwiseAND(F.lit(127))
    level = F.when(m == 0, LEVELS - 1).otherwise(LEVELS - 1 - F.length(F.bin(m)))
    return F.struct(
        F.array(*[_number(digests[i // 4], 1 + 15 * (i % 4), 15) for i in range(LANES)]).alias("dense"),
        (level * CELLS + F.pmod(_number(digests[1], 61, 4), F.lit(CELLS))).cast("int").alias("cell"),
        (1 + F.pmod(_number(digests[0], 61, 4), F.lit(CELL_MASK))).alias("value"))


def _modulo(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask))


def fingerprint(text: Column) -> Column:
    """struct<n: long, dense: array<long>, cells: array<long>>"""
    paragraphs = F.when(F.coalesce(text, F.lit("")) != "", F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))
    digests = F.transform(paragraphs, lambda p: F.array(*[F.sha2(F.concat(F.lit(f"{j}:"), p), 256) for j in range(LANES // 4)]))
    return let(F.transform(digests, _vector), lambda v: F.struct(
        _modulo(F.size(v).cast("long"), COUNT_MASK).alias("n"),
        F.aggregate(v, F.array_repeat(F.lit(0).cast("long"), LANES), lambda acc, x: F.zip_with(acc, x["dense"], lambda a, b: _modulo(a + b, MASK))).alias("dense"),
        F.transform(F.sequence(F.lit(0), F.lit(LEVELS * CELLS - 1)), lambda c: _modulo(
            F.aggregate(v, F.lit(0).cast("long"), lambda s, x: F.when(x["cell"] == c, s + x["value"]).otherwise(s)), CELL_MASK)).alias("cells")))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """Fingerprint of both texts' paragraphs together (sign 1), or of a's without b's (sign -1)."""
    both = lambda c, mask: F.zip_with(a[c], b[c], lambda x, y: _modulo(x + sign * y, mask)).alias(c)
    return F.struct(_modulo(a["n"] + sign * b["n"], COUNT_MASK).alias("n"), both("dense", MASK), both("cells", CELL_MASK))


def digits(f: Column) -> Column:
    """The fingerprint as hex digits of fixed width."""
    each = lambda c, n: F.array_join(F.transform(f[c], lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.lower(F.concat(F.lpad(F.hex(f["n"]), 8, "0"), each("dense", 15), each("cells", 4)))


def likeness(a: Column, b: Column) -> Column:
    """Common paragraphs over all paragraphs of both, as their fingerprints tell (1.0: equal)."""
    diff = F.zip_with(a["cells"], b["cells"], lambda x, y: (x != y).cast("int"))
    hit = let(diff, lambda d: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda j: F.aggregate(F.slice(d, j * CELLS + 1, F.lit(CELLS)), F.lit(0), lambda s, x: s + x)))

    def differing(z: Column) -> Column:
        items = [-CELLS * F.log(1 - F.least(z[j].cast("double"), F.lit(CELLS - 0.5)) / CELLS) for j in range(LEVELS)]
        out = 2.0 ** (LEVELS - 1) * items[-1]
        for j in range(LEVELS - 2, -1, -1):
            below = F.array_max(F.slice(z, j + 1, LEVELS - j)) <= CROWDED
            out = F.when(below, 2.0 ** j * sum(items[j + 1:], items[j])).otherwise(out)
        return out

    total = a["n"] + b["n"]
    d = F.least(F.greatest(let(hit, differing), F.abs(a["n"] - b["n"]).cast("double"), F.lit(1.0)), total.cast("double"))
    same = (a["dense"] == b["dense"]) & (a["n"] == b["n"])
    return F.when(same, F.lit(1.0)).otherwise(let(d, lambda d: (total - d) / (total + d)))


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", bucket_rows: int = 1000, most_cuts: int = 1000) -> DataFrame:
    """id, text ('' for null), fp, and next_text and next_fp of the row with the next lower id (after the last: of the first)."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
        raise ValueError("ids must be numbers")
    d = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = docs.count()
    n = max(2, min(most_cuts, math.ceil(rows / bucket_rows)))
    at = F.col(doc_id).cast("double")
    seen = docs.agg(F.percentile_approx(at, [i / n for i in range(1, n)], 10 * n).alias("c"), F.min(at).alias("lo"), F.max(at).alias("hi")).first()
    cuts = seen["c"] or [0.0]
    hot = sorted({x for x, y in zip(cuts, cuts[1:]) if x == y and abs(x) < 2 ** 52})
    splits = sorted({-math.inf, math.inf, *cuts, *hot, *(math.nextafter(x, math.inf) for x in hot)})
    d = Bucketizer(splits=splits, inputCol="at", outputCol="range").transform(d.withColumn("at", F.coalesce(F.col("id").cast("double"), F.lit(0.0))))
    # a range is cut into equal widths of ids, so the number of quantiles may stay small
    parts = math.ceil(rows / n / bucket_rows)
    width = max(256, parts)
    ends = [seen["lo"] or 0.0, *splits[1:-1], seen["hi"] or 0.0]
    side = lambda xs: F.array(*map(F.lit, xs))[F.col("range").cast("int")]
    lo, hi = side(ends[:-1]), side(ends[1:])
    part = F.floor((F.col("at") - lo) / F.greatest(hi - lo, F.lit(1e-300)) * parts)
    down = parts - 1 - F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)) if parts > 1 else F.lit(0)
    spread = (F.shiftright("h", 56) + 128).cast("long")
    alone = F.col("at").isin(hot) if hot else F.lit(False)
    b = F.when(F.col("id").isNull(), (len(splits) + 1) * width + spread).otherwise((len(splits) - F.col("range").cast("long")) * width + F.when(alone, spread).otherwise(down))
    # never null: a filter under one of the two readers of this exchange would make it two exchanges
    d = d.select(F.coalesce(b, F.lit(0)).alias("b"), "id", "h", "text").repartition("b")
    order = W.partitionBy("b").orderBy(F.col("id").desc_nulls_last(), "h", "text")
    heads = d.withColumn("r", F.row_number().over(order)).where("r = 1").select("b", "text")
    # one row per bucket: the bucket that follows, and its first text
    turn = W.orderBy("b")
    after = heads.select("b", F.coalesce(F.lead("b").over(turn), F.first("b").over(turn)).alias("b2"))
    after = after.join(heads.select(F.col("b").alias("b2"), F.col("text").alias("head")), "b2").select("b", "head")
    d = d.withColumn("fp", fingerprint(F.col("text")))
    d = d.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).alias("d")
    d = d.join(after.alias("a"), (F.col("d.b") == F.col("a.b")) & F.col("d.next").isNull(), "left")
    return d.select("id", "text", "fp", F.coalesce("next.text", "head").alias("next_text"), F.coalesce("next.fp", fingerprint(F.col("head"))).alias("next_fp"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = followed(read(spark, sf_dir, "documents"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    d = d.select("id", "fp", "next_fp", n.cast("long").alias("n_chars"), edited.alias("edited"))
    both = let(fingerprint(F.col("edited")), lambda e: F.struct(digits(e).alias("edited_fingerprint"), F.round(likeness(F.col("fp"), e), 6).alias("near_edited")))
    return d.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digits(F.col("fp")).alias("fingerprint"),
                    both.alias("e"), F.round(likeness(F.col("fp"), F.col("next_fp")), 6).alias("near_next")) \
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "e.edited_fingerprint", "e.near_edited", "near_next")


def _sql() -> str:
    """The whole query in DuckDB's SQL; paragraphs are rows, components are columns."""
    num = lambda h, at, k: f"('0x' || substr({h}, {at}, {k}))::bigint"
    dense = ", ".join(f"{num(f'h{i // 4}', 1 + 15 * (i % 4), 15)} as d{i}" for i in range(LANES))
    sums = ", ".join(f"(sum(d{i}) % {1 << 60})::bigint as d{i}" for i in range(LANES))
    m = f"({num('h2', 61, 4)} & 127)"
    z = ["-{c}e0 * ln(1e0 - least(z[{j}]::double, {t!r}) / {c}e0)".format(c=CELLS, j=j + 1, t=CELLS - .5) for j in range(LEVELS)]
    est = f"{2.0 ** (LEVELS - 1)!r}::double * ({z[-1]})"
    for j in range(LEVELS - 2, -1, -1):
        est = f"case when list_max(z[{j + 1}:{LEVELS}]) <= {CROWDED} then {2.0 ** j!r}::double * ({' + '.join(z[j:])}) else {est} end"
    hexes = " || ".join(f"lpad(lower(to_hex(d{i})), 15, '0')" for i in range(LANES))
    same = " and ".join(f"a.d{i} = b.d{i}" for i in range(LANES))
    return f"""
with docs as (select doc_id, coalesce(text, '') as text from documents),
  nx as (select doc_id, text, length(text) as n, coalesce(lead(text) over (order by doc_id desc), first(text) over (order by doc_id desc)) as nt,
           coalesce(lead(doc_id) over (order by doc_id desc), first(doc_id) over (order by doc_id desc)) as next_id from docs),
  tx as (select doc_id, 0 as e, text from docs union all select doc_id, 1, left(text, n - n // 2) || left(nt, n // 2) from nx),
  par as (select doc_id, e, unnest(string_split(text, chr(10))) as p from tx where text <> ''),
  hs as (select doc_id, e, {', '.join(f"sha256('{j}:' || p) as h{j}" for j in range(LANES // 4))} from par),
  vs as (select doc_id, e, {dense}, case when {m} = 0 then {LEVELS - 1} else {LEVELS - 1} - length(bin({m})) end * {CELLS} + {num('h1', 61, 4)} % {CELLS} as cell,
           1 + {num('h0', 61, 4)} % {CELL_MASK} as v from hs),
  dn as (select doc_id, e, count(*) as n, {sums} from vs group by 1, 2),
  cl as (select doc_id, e, cell, (sum(v) % {CELL_MASK + 1})::bigint as v from vs group by 1, 2, 3),
  grid as (select doc_id, e, range as cell from tx cross join range({LEVELS * CELLS})),
  cs as (select doc_id, e, list(coalesce(v, 0) order by cell) as c from grid left join cl using (doc_id, e, cell) group by 1, 2),
  f as (select cs.doc_id, cs.e, c, coalesce(dn.n, 0) as n, {', '.join(f'coalesce(d{i}, 0) as d{i}' for i in range(LANES))} from cs left join dn using (doc_id, e)),
  hx as (select doc_id, e, lpad(lower(to_hex(n)), 8, '0') || {hexes} || array_to_string(list_transform(c, lambda x: lpad(lower(to_hex(x)), 4, '0')), '') as h from f),
  pr as (select doc_id, doc_id as other, 1 as e from docs union all select doc_id, next_id, 0 from nx),
  df as (select pr.doc_id, pr.e, {same} and a.n = b.n as same, a.n + b.n as total, abs(a.n - b.n) as gap,
           list_transform(range({LEVELS}), lambda j: len(list_filter(range(1, {CELLS + 1}), lambda i: a.c[j * {CELLS} + i] <> b.c[j * {CELLS} + i]))) as z
         from pr join f a on a.doc_id = pr.doc_id and a.e = 0 join f b on b.doc_id = pr.other and b.e = pr.e),
  es as (select doc_id, e, same, total, least(greatest({est}, gap::double, 1e0), total::double) as d from df),
  lk as (select doc_id, e, case when same then 1e0 else round((total - d) / (total + d), 6) end as l from es)
select docs.doc_id, length(docs.text)::bigint as n_chars, sha256(t1.text) as edited_sha256, h0.h as fingerprint, h1.h as edited_fingerprint, l1.l as near_edited, l0.l as near_next
from docs join tx t1 on t1.doc_id = docs.doc_id and t1.e = 1 join hx h0 on h0.doc_id = docs.doc_id and h0.e = 0 join hx h1 on h1.doc_id = docs.doc_id and h1.e = 1
  join lk l1 on l1.doc_id = docs.doc_id and l1.e = 1 join lk l0 on l0.doc_id = docs.doc_id and l0.e = 0
"""


OP12_SQL = _sql()
