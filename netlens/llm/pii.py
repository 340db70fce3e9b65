"""Information-theoretic sanitisation of personal data, with DataFrame functions only.

Protected entities are the matches of the base kinds. For every term of a document with an entity the corpus tells how
strongly it reveals the entity: PMI(term; entity) against the entity's information content IC = log(N / documents with
it), all counted by document. A term that shares a document with an entity, be it one, and whose PMI reaches `threshold`
of IC is a span of the kind "term" wherever it stands in documents that hold the entity: it is generalised to a class
below `remove` of IC and removed from there on. Chance hits are curbed by the threshold: a term tells an entity of one
document only if about N^(1 - threshold) documents hold the term, or fewer.

Base kinds are leftmost, non-overlapping matches; the patterns below are possessive or anchored forms of the plain ones
that match the same spans in linear time. Positions are code points, from running sums over the lengths of matches and
of what lies between them, so a text costs time in proportion to its length, however many matches it has. Entities that
the same documents hold tell the same, so each such class is scored once, and texts that are equal are scored as one
that counts as often as documents hold it.

Defined cases: null text is empty; texts are scanned whole, a very long one in the memory of one row, about forty times
its length; rows that repeat a document count as one document and give equal rows each; a null doc_id is a document like
others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import BROADCAST, Scratch, bounded, weight

THRESHOLD, REMOVE, STEP, BLOCK = 0.8, 0.95, 64, 1024
#: Stands for each letter of an e-mail address while terms are looked for; no text has this noncharacter in a word.
MASK = "\ufdd0"
SPAN = "array<struct<kind:string,start:long,end:long,value:string>>"
WORDS = "array<struct<term:string,start:long,end:long>>"

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])(?=(?:[0-9][\x20-]?){15}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"[\p{L}\p{M}\x{FDD0}]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, op: Callable[[Column, Column], Column], levels: int = 3) -> Column:
    """For each value what op makes of all values before it. A value looks at the rest of its step only, and each step
    at the rest of its step of steps, so the work grows with the number of values."""

    def fold(part: Column) -> Column:
        return F.aggregate(part, zero, op)

    def level(v: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / STEP).cast("int")), lambda k: fold(F.slice(v, k * STEP + 1, STEP)))
        heads = running(steps, zero, op, levels - 1)

        def at(i: Column, h: Column) -> Column:
            k = F.floor(i / STEP).cast("int")
            return op(F.element_at(h, k + 1), fold(F.slice(v, k * STEP + 1, i - k * STEP)))

        return let(heads, lambda h: F.transform(v, lambda _, i: at(i, h)))

    if levels == 1:
        return let(values, lambda v: F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i))))
    return let(values, level)


def _sums(values: Column) -> Column:
    return running(values, F.lit(0).cast("long"), lambda a, b: a + b)


def _size(x: Column) -> Column:
    return F.length(x).cast("long")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether the digits of v pass the Luhn sum."""

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, twice).otherwise(d)

    each = F.transform(F.split(F.reverse(_digits(v)), "(?<=[0-9])(?=[0-9])"), one)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _count(v: Column, lo: int, hi: int) -> Column:
    return F.length(_digits(v)).between(lo, hi)


#: kind, pattern, what a match must pass, what a text must hold for a look at all.
KINDS: tuple[tuple[str, str, Callable[[Column], Column], Callable[[Column], Column]], ...] = (
    ("email", EMAIL, lambda v: F.lit(True), lambda t: F.contains(t, F.lit("@"))),
    ("ip", IP, lambda v: v.rlike(rf"^(?:{BYTE}\.){{3}}{BYTE}$"), lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", CARD, lambda v: _count(v, 16, 19) & luhn(v), lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    ("phone", PHONE, lambda v: _count(v, 8, 15), lambda t: t.rlike(r"\+[0-9]")),
)


def _found(text: Column, pattern: str) -> Column:
    """(vals, gaps, at): matches, the one more strings between them, and where each match begins."""
    pair = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("vals"), F.split(text, pattern, -1).alias("gaps"))

    def place(p: Column) -> Column:
        both = F.zip_with(p["vals"], F.slice(p["gaps"], F.lit(1), F.size(p["vals"])), lambda v, g: _size(v) + _size(g))
        at = F.zip_with(_sums(both), F.slice(p["gaps"], F.lit(1), F.size(p["vals"])), lambda n, g: n + _size(g))
        return F.struct(p["vals"].alias("vals"), p["gaps"].alias("gaps"), at.alias("at"))

    return let(pair, place)


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a pattern as spans."""

    def span(v: Column, start: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + _size(v)).alias("end"), v.alias("value"))

    return F.when(text.rlike(pattern), let(_found(text, pattern), lambda f: F.zip_with(f["vals"], f["at"], span))).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind, then start."""
    def of(kind: str, pattern: str, passes: Callable[[Column], Column], look: Callable[[Column], Column]) -> Column:
        found = F.filter(matches(text, pattern, kind), lambda s: passes(s["value"]))
        return F.when(look(text), found).otherwise(F.array().cast(SPAN))

    return F.concat(*(of(*k) for k in KINDS))


def _masked(text: Column) -> Column:
    """The text with each letter of an e-mail address masked; other base kinds hold none."""
    gone = lambda f: F.concat(F.transform(f["vals"], lambda v: F.regexp_replace(v, "[A-Za-z]", MASK)), F.array(F.lit("")))
    pair = F.struct(F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0)).alias("vals"), F.split(text, EMAIL, -1).alias("gaps"))
    masked = let(pair, lambda f: F.array_join(F.zip_with(f["gaps"], gone(f), lambda g, m: F.concat(g, m)), ""))
    return F.when(text.rlike(EMAIL), masked).otherwise(text)


def _words(text: Column) -> Column:
    """Every term of a text with its place, whole ones that overlap no base span."""

    def word(v: Column, start: Column) -> Column:
        return F.struct(F.lower(v).alias("term"), start.alias("start"), (start + _size(v)).alias("end"))

    return let(_found(_masked(text), TERM), lambda f: F.filter(F.zip_with(f["vals"], f["at"], word), lambda w: ~F.contains(w["term"], F.lit(MASK))))


def _entities(base: Column) -> Column:
    return F.array_distinct(F.transform(base, lambda b: F.concat_ws(":", b["kind"], F.lower(b["value"]))))


def disclosing(held: DataFrame, words: DataFrame, docs: DataFrame, s: Scratch, threshold: float) -> DataFrame:
    """(class, term, ratio): terms whose PMI with the entities of a class reaches the threshold of their information
    content. held(key, class, n_entity, copies) of the texts with entities, each once, copies the documents that have the
    text; words(key, term) of the same texts, repeated or not; docs(doc_id, _h, text) are all rows."""
    known = s.cut(words.select("term").distinct(), "terms", True, True)
    n = max(docs.select("doc_id", "_h").distinct().count(), 1)
    once = docs.dropDuplicates(["doc_id", "_h"]) if docs.count() > n else docs  # texts are shuffled only where rows repeat
    terms = once.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{M}]+"))).alias("term"))
    if weight(known)[1] <= BROADCAST:
        n_term = terms.join(F.broadcast(known), "term").groupBy("term").agg(F.count("*").alias("n_term"))
    else:  # counted before they meet, so that each task sends a term once
        n_term = terms.groupBy("term").agg(F.count("*").alias("n_term")).join(known, "term")
    # n_both is n_entity at most, so a term of more documents than this reaches the threshold with no entity of n_entity.
    most = lambda e: F.pow(F.lit(float(n)), F.lit(1 - threshold)) * F.pow(e, F.lit(threshold)) * (1 + 1e-6)
    top = held.agg(F.max("n_entity")).first()[0] or 0
    rare = s.cut(n_term.where(F.col("n_term") <= most(F.lit(float(top)))), "rare", True, True)
    pairs = words.join(bounded(rare), "term").distinct().join(held, "key").where(F.col("n_term") <= most(F.col("n_entity")))
    pairs = pairs.groupBy("class", "term").agg(F.sum("copies").alias("n_both"), F.max("n_entity").alias("n_entity"), F.max("n_term").alias("n_term"))
    pmi = F.log(F.lit(float(n)) * F.col("n_both") / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    ic = F.log(F.lit(float(n)) / F.col("n_entity"))
    return pairs.where(ic > 0).withColumn("ratio", pmi / ic).where(F.col("ratio") >= threshold - 1e-9).select("class", "term", "ratio")


KINDS_OF_SPANS = "array<struct<kind:string,start:long,end:long,value:string,ratio:double>>"


def pii_spans(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, spans, sanitised) of every row: base spans by kind and start, all spans with the method's after
    them, and the sanitised text, null where a text has no span and so stays as it is."""
    s = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("_h", F.xxhash64("text"))
    rows = texts.withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    rows = rows.withColumn("words", F.when(some, _words(F.col("text"))).otherwise(F.array().cast(WORDS)))
    rows = s.cut(rows.select("doc_id", F.when(some, F.col("_h")).alias("key"), "base", "words", F.when(some, F.col("text")).alias("text")), "rows")
    hits = rows.where("key is not null")
    copies = hits.select("key", "doc_id").distinct().groupBy("key").agg(F.count("*").alias("copies"))
    entity = hits.select("key", F.explode(_entities(F.col("base"))).alias("entity")).distinct().join(copies, "key")
    entity = s.cut(entity, "entity", True)
    # Entities of the same documents, by their number and two sums of hashes, are one class.
    by = entity.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64("key", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).alias("y"))
    by = by.select("entity", F.xxhash64("n_entity", "x", "y").alias("class"), "n_entity")
    held = s.cut(entity.join(by, "entity").select("key", "class", "n_entity", "copies").distinct(), "held", True)
    words = hits.select("key", F.explode(F.array_distinct(F.col("words.term"))).alias("term"))
    told = s.cut(disclosing(held, words, texts, s, threshold), "told", True)
    telling = s.cut(held.join(told, "class").groupBy("key", "term").agg(F.max("ratio").alias("ratio")), "telling", True)
    at = hits.select("key", F.explode("words").alias("w")).select("key", "w.*").join(bounded(telling), ["key", "term"])
    at = at.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "end", F.lit("term").alias("kind"), F.col("term").alias("value"), "ratio"))).alias("more"))
    got = hits.join(bounded(s.cut(at, "at", True)), "key", "left")
    full = lambda b: F.struct(b["kind"], b["start"], b["end"], b["value"], F.lit(None).cast("double").alias("ratio"))
    extra = lambda m: F.struct(m["kind"], m["start"], m["end"], m["value"], m["ratio"])
    spans = F.concat(F.transform("base", full).cast(KINDS_OF_SPANS), F.coalesce(F.transform("more", extra).cast(KINDS_OF_SPANS), F.array().cast(KINDS_OF_SPANS)))
    out = got.select("doc_id", "base", spans.alias("spans"), "text").select("doc_id", "base", "spans", sanitise(F.col("text"), F.col("spans")).alias("sanitised"))
    none = rows.where("key is null").select("doc_id", "base", F.array().cast(KINDS_OF_SPANS).alias("spans"), F.lit(None).cast("string").alias("sanitised"))
    return s.finish(out.unionByName(none))


def sanitise(text: Column, spans: Column, remove: float = REMOVE) -> Column:
    """The text with base spans replaced by their kind, telling terms by a class or nothing. Of spans that overlap the
    first gives its label and all of them go. Pieces are cut from blocks of the text, so the time is linear."""

    def whole(x: Column) -> Column:
        long = lambda v: F.lit(v).cast("long")
        blocks, by = x["blocks"], x["by"]

        def piece(lo: Column, hi: Column) -> Column:
            i, j = F.floor(lo / BLOCK).cast("int"), F.floor(hi / BLOCK).cast("int")
            first, last = F.coalesce(F.get(blocks, i), F.lit("")), F.coalesce(F.get(blocks, j), F.lit(""))
            a, b = (lo - i * BLOCK).cast("int"), (hi - j * BLOCK).cast("int")
            across = F.concat(F.substring(first, a + 1, F.lit(BLOCK)), F.array_join(F.slice(blocks, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), F.substring(last, F.lit(1), b))
            return F.when(lo >= hi, "").when(i == j, F.substring(first, a + 1, b - a)).otherwise(across)

        def label(s: Column) -> Column:
            return F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["ratio"] >= remove, F.lit("")).otherwise(F.lit("[TERM]"))

        before = running(F.transform(by, lambda s: s["end"]), long(0), lambda a, b: F.greatest(a, b))
        parts = F.zip_with(by, before, lambda s, at: F.when(s["start"] < at, "").otherwise(F.concat(piece(at, s["start"]), label(s))))
        end = F.aggregate(by, long(0), lambda a, s: F.greatest(a, s["end"]))
        return F.concat(F.array_join(parts, ""), let(end, lambda e: piece(e, x["size"])))

    by = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"], s["ratio"])))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return let(F.struct(by.alias("by"), blocks.alias("blocks"), _size(text).alias("size")), whole)
