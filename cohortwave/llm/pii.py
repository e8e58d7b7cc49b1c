"""Personal data by bootstrapped contextual extraction.

Base detectors (e-mail, IP address, card, phone) give seed entities. Every seed
and every other identifier-like token (with a digit or an at sign) is an
instance with lexical patterns: the words around it. Spark scores the graph of
distinct (pattern, instance) edges in rounds: a pattern's confidence is the
share of its instances that are trusted as one kind, an instance's score is one
minus the product of (1 - confidence) over accepted patterns. Rounds go on until
one accepts and raises nothing. Accepted patterns
thereby find identifiers that no detector knows; their tokens are added to the
base spans, which always stay.

All scanning is linear in the text. Edges and scores are aggregated before the
shuffle, written between rounds and never collected.

Edge cases: null and empty texts have no spans; repeated rows are scanned each,
and count once as instances (edges are distinct); an empty table gives no rows.
Offsets are code points, ends exclusive. Only the named columns are read.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .common import free_name, join_bounded, map_batches, read, row_key

KINDS = ("email", "ip", "card", "phone")
BLANKS = frozenset(" \t\n\x0b\x0c\r")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, MARK, BLANK, EDGE = re.compile("[0-9]"), re.compile("[0-9@]"), re.compile(r"[ \t-\r]"), " .,;:!?()[]{}<>\"'`*#$%&|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the detectors, sorted; leftmost, non-overlapping per kind."""
    out = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            s = m.start()
            while s > end and text[s - 1] in LOCAL:
                s -= 1
            if s < m.start():
                end = m.end()
                out.append((s, 0, end))
    first = DIGIT.search(text)
    if not first:
        return out
    at = first.start()
    if "." in text:
        for m in CHAIN.finditer(text, at):
            parts = m[0].split(".")
            s = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i:i + 4]
                e = s + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    out.append((s, 1, e))
                s = e + 1
    for m in CARD.finditer(text, at):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _word_before(text: str, p: int) -> tuple[str, int]:
    """The word that ends before p (its last 40 characters) and its start."""
    while p > 0 and text[p - 1] in BLANKS:
        p -= 1
    e = p
    while p > max(0, e - 40) and text[p - 1] not in BLANKS:
        p -= 1
    return text[p:e].strip(EDGE).lower(), p


def _word_after(text: str, p: int) -> tuple[str, int]:
    while p < len(text) and text[p] in BLANKS:
        p += 1
    s = p
    while p < min(len(text), s + 40) and text[p] not in BLANKS:
        p += 1
    return text[s:p].strip(EDGE).lower(), p


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """(start, end, kind or -1, instance, patterns) of the base spans and of the other tokens with a digit or an at sign."""
    spans: list[tuple[int, int, int]] = []
    for s, kind, e in base:  # overlapping detectors see one instance
        if spans and s < spans[-1][2]:
            spans[-1] = (*spans[-1][:2], max(e, spans[-1][2]))
        else:
            spans.append((s, kind, e))
    i, free, known = 0, 0, [*spans, (len(text), -1, len(text))]
    m = MARK.search(text)
    while m:
        p = m.start()
        while known[i][2] <= p:
            i += 1
        if known[i][0] <= p:
            p = free = known[i][2]
        else:
            free = max(free, known[i - 1][2] if i else 0)
            s = p
            while s > free and text[s - 1] not in BLANKS:
                s -= 1
            b = BLANK.search(text, p)
            p = free = min(b.start() if b else len(text), known[i][0])
            core = text[s:p].lstrip(EDGE)
            s, core = p - len(core), core.rstrip(EDGE)
            if 4 <= len(core) <= 200 and ("@" in core or sum(map(str.isdigit, core)) >= 3):
                spans.append((s, -1, s + len(core)))
        m = MARK.search(text, p)
    spans.sort()
    out = []
    for s, kind, e in spans:
        l1, p = _word_before(text, s)
        l2, _ = _word_before(text, p)
        r1, p = _word_after(text, e)
        r2, _ = _word_after(text, p)
        out.append((s, e, kind, text[s:min(e, s + 200)].lower(), [f"{l2} {l1} _", f"{l1} _ {r1}", f"_ {r1} {r2}"]))
    return out


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, rid, base and occ of each row; write it before it is read twice."""
    df = docs.select(*keep, F.monotonically_increasing_id().alias("rid"), F.col(text).alias("body"))
    types = dict(df.dtypes)

    def run(b):
        base, occ = [], []
        for t in b.column("body").to_pylist():
            spans = base_spans(t) if t else []
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            occ.append([{"start": s, "end": e, "kind": k, "inst": i, "pats": p} for s, e, k, i, p in (occurrences(t, spans) if t else [])])
        return {c: b.column(c) for c in [*keep, "rid"]} | {"base": base, "occ": occ}

    return map_batches(df, run, ", ".join(f"`{c}` {types[c]}" for c in [*keep, "rid"]) +
                       ", base array<struct<start:int,kind:int,end:int>>, occ array<struct<start:int,end:int,kind:int,inst:string,pats:array<string>>>")


def bootstrap(scanned: DataFrame, confidence: float = 0.8, support: int = 3, accept: float = 0.9) -> DataFrame:
    """inst and kind of identifiers that patterns find and no detector knows."""
    occ = scanned.select(F.explode("occ").alias("o")).select("o.*")
    edges = cut_lineage(occ.select("inst", "kind", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind >= 0").select("inst", "kind", F.lit(1.0).alias("score")).distinct()
    found = seeds.limit(0)
    while True:
        trusted = seeds.unionByName(found)
        by_kind = (edges.select("pat", "inst").join(trusted, "inst", "left").groupBy("pat", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("s")))
        pats = (by_kind.groupBy("pat").agg(F.sum("n").alias("n"), F.max_by("kind", F.struct(F.coalesce("s", F.lit(0.0)), -F.col("kind"))).alias("kind"), F.max("s").alias("s"))
                .withColumn("conf", F.col("s") / F.col("n")).where((F.col("s") >= support) & (F.col("conf") >= confidence)).select("pat", "kind", "conf"))
        pats = cut_lineage(pats, "patterns")
        scored = (edges.where("kind < 0").select("pat", "inst").join(pats, "pat").groupBy("inst", "kind")
                  .agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score")).where(F.col("score") >= accept)
                  .groupBy("inst").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"), F.max("score").alias("score")))
        # scores only rise, in steps of 0.001, and accepted kinds stay: the rounds come to an end
        scored = scored.join(seeds.select("inst"), "inst", "left_anti").withColumn("score", F.floor(F.col("score") * 1000) / 1000)
        old = found.select("inst", F.col("kind").alias("was"), F.col("score").alias("had"))
        new = cut_lineage(scored.join(old, "inst", "full").select("inst", F.coalesce("was", "kind").alias("kind"), F.greatest("score", "had").alias("score"),
                                                                  (F.col("had").isNull() | (F.col("score") > F.col("had"))).alias("up")), "found")
        found, grown = new.drop("up"), not new.where("up").isEmpty()
        if not grown:
            break
    return found.select("inst", "kind")


def extract(docs: DataFrame, keep: list[str], text: str = "text", **how) -> DataFrame:
    """keep, base and more (arrays of start, kind, end)."""
    scanned = cut_lineage(scan(docs, keep, text), "pii")
    found = bootstrap(scanned, **how)
    occ = scanned.select("rid", F.explode("occ").alias("o")).where("o.kind < 0").select("rid", "o.start", "o.end", "o.inst")
    more = join_bounded(occ, found, "inst", "inner").groupBy("rid").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    return scanned.drop("occ").join(more, "rid", "left").withColumn("more", F.coalesce("more", F.filter("base", lambda x: F.lit(False)))).drop("rid")


def spans_text(spans):
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", kind[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "documents"), ["doc_id"])
    n = lambda i: F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long")
    return out.select("doc_id", *[n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                      spans_text(F.concat("base", "more")).alias("spans"), F.size("more").cast("long").alias("n_found"))


def redacted(text: str | None, spans) -> str | None:
    """The text with each run of overlapping spans replaced by the first one's kind."""
    if not text or not spans:
        return text
    out, end = [], 0
    for s, k, e in sorted((x["start"], x["kind"], x["end"]) for x in spans):
        if s >= end:
            out += [text[end:s], f"<{KINDS[k].upper()}>"]
        end = max(end, e)
    return "".join([*out, text[end:]])


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    row, found = free_name(docs, "__row"), free_name(docs, "__spans")
    keyed = docs.withColumn(row, row_key(docs))
    spans = extract(keyed, [row]).select(row, F.concat("base", "more").alias(found)).where(F.size(found) > 0).dropDuplicates([row])
    both = join_bounded(keyed, cut_lineage(spans, "spans"), row, "left", 200_000).select(*[f"`{c}`" for c in docs.columns], found)
    types = dict(docs.dtypes)

    def run(b):
        text = [redacted(t, s) for t, s in zip(b.column("text").to_pylist(), b.column(found).to_pylist())]
        return {c: b.column(c) for c in docs_columns} | {"text": text}

    docs_columns = docs.columns
    out = map_batches(both, run, ", ".join(f"`{c}` {types[c]}" for c in docs_columns))
    return out.withColumn("n_chars", F.length("text").cast(types["n_chars"])) if "n_chars" in types else out
