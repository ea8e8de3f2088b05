"""Information-theoretic sanitisation of personal data.

Protected entities are what fixed patterns find: e-mail addresses, IP addresses, payment cards, phone numbers;
leftmost and without overlap within a kind, matches that fail their check are dropped.  A term is a word near
an entity.  All counts are of distinct texts, so copies change nothing: in how many a term stands near an entity
(c), in how many the entity stands (n), and in how many the term stands at all (df).  From

    PMI(term; entity) = log2(p(entity | term) / p(entity))        IC(entity) = -log2 p(entity)

follows how much of the entity's information the term gives away.  p(entity | term) is c / df where c is ``MIN_CONTEXTS``
or more; below, where counts are few, it is smoothed to c / (df + ``SMOOTH``), and the term must stand in half of the
entity's texts.  p(entity) is n over all distinct texts.  A term discloses the entity where PMI >= ``DISCLOSED`` * IC: the
rarer the entity, the more other texts the term may stand in.
So does a term near it that discloses the entity's kind, all entities of a kind taken as one; thus a name
beside many addresses, each met once, is found.  In documents with that entity, the term is a span of the kind
``term``, and sanitised texts have it generalised (names, by their capital, to [NAME]) or removed (others, to
[TERM]).

Null text counts as empty; repeated rows give repeated results; an empty table gives no rows.  All scans take
time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.llm.common import rows, saved, tune

KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of an entity that are its context.
NEAR_WORDS = 8
#: Share of an entity's information that a disclosing term gives away; texts from which c / df isn't smoothed; its smoothing.
DISCLOSED, MIN_CONTEXTS, SMOOTH = 0.9, 3, 0.5
#: Bits of the filters of terms and of copied texts; their size doesn't grow.
FILTER_BITS = 1 << 23

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A number's first digit alone may start a match: from a later one, what follows is the same.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def find_entities(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as in KINDS, end) of the base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []
    return sorted(out)


def entity_key(kind: int, found: str) -> str:
    return f"{KINDS[kind]}:{found.lower() if kind == 0 else ''.join(c for c in found if c.isdigit() or c == '.' and kind == 1)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[str]]]:
    """(entity, the distinct terms near it) of each base span; terms inside of spans don't count."""
    bare, done = [], 0  # the text with base spans blanked, position by position
    for a, _, b in spans:
        bare += [text[done:a], " " * (b - max(a, done))]
        done = max(done, b)
    words = list(TERM.finditer("".join([*bare, text[done:]])))
    starts, ends = [m.start() for m in words], [m.end() for m in words]
    out = []
    for a, k, b in spans:  # none of the words overlaps a span
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        near = words[max(0, before - NEAR_WORDS) : before] + words[after : after + NEAR_WORDS]
        out.append((entity_key(k, text[a:b]), sorted({m.group().lower() for m in near})))
    return out


def term_spans(text: str, terms: set[str], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Where disclosing terms stand outside of base spans."""
    out, i, base = [], 0, sorted((a, b) for a, _, b in spans)
    reach = 0
    for m in TERM.finditer(text):
        if m.group().lower() in terms:
            while i < len(base) and base[i][0] < m.end():
                reach = max(reach, base[i][1])
                i += 1
            if reach <= m.start():
                out.append((m.start(), 4, m.end()))
    return out


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans that overlap are replaced as one, under the name of the first."""
    out, done = [], 0
    for a, k, b in sorted(spans):
        if a >= done:
            mark = KINDS[k].upper() if k < 4 else "NAME" if text[a].isupper() else "TERM"
            out += [text[done:a], f"[{mark}]"]
            done = b
        else:
            done = max(done, b)
    return "".join([*out, text[done:]])


def _word(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _spans(written: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in written.split(",") if x)]


FOUND = "array<struct<entity:string,terms:array<string>>>"
_FOUND_ARROW = pa.list_(pa.struct([("entity", pa.string()), ("terms", pa.list_(pa.string()))]))


def _analysed(docs: DataFrame, text_col: str, carried: list[str], whole: bool) -> DataFrame:
    """carried columns (a struct), text (whole, or only where entities are), spans, found, hash of the text; in the shared folder, with a row number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.struct(*carried).alias("row"), text.alias("text"), F.xxhash64(text).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            texts = b.column(1).to_pylist()
            spans = [find_entities(t) for t in texts]
            found = [[dict(zip(("entity", "terms"), c, strict=True)) for c in contexts(t, s)] if s else [] for t, s in zip(texts, spans, strict=True)]
            kept = texts if whole else [t if s else None for t, s in zip(texts, spans, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(kept, pa.string()), pa.array(map(_word, spans), pa.string()), pa.array(found, _FOUND_ARROW), b.column(2)], ["row", "text", "spans", "found", "hash"])

    row = source.schema["row"].dataType
    schema = T.StructType().add("row", row).add("text", "string").add("spans", "string").add("found", T.DataType.fromDDL(FOUND)).add("hash", "long")
    return saved(source.mapInArrow(run, schema).withColumn("nr", F.monotonically_increasing_id()), "entities")


def _filter(hashes: DataFrame) -> np.ndarray:
    """The bits of a filter that passes all of ``hashes`` (column h)."""
    bit = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    got = hashes.select((bit + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in got:  # at most FILTER_BITS in all
        bits[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _frequencies(terms: DataFrame, found: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """term, df: the distinct texts with each of ``terms`` (and perhaps of other terms).

    Texts that have no copy are summed in the batch; those that may have leave it by hash, and count once.
    """
    bits = _filter(terms.select(F.xxhash64("term").alias("h")))
    copied = _filter(found.groupBy("hash").count().where("count > 1").select(F.col("hash").alias("h")))
    shared = docs.sparkSession.sparkContext.broadcast((bits, copied))
    any_ = bool(bits.any())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, again = shared.value
        passed: dict[str, bool] = {}

        def wanted(w: str) -> bool:
            ok = passed.get(w)
            if ok is None:
                if len(passed) > 500_000:
                    passed.clear()
                h = _spark_hash(w) % FILTER_BITS
                ok = passed[w] = bool(have[h >> 3] >> (h & 7) & 1)
            return ok

        for b in rows(batches):
            seen: Counter = Counter()
            met: dict[int, set[str]] = {}
            for t, text_hash in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if any_ else ():
                h = text_hash % FILTER_BITS
                if not again[h >> 3] >> (h & 7) & 1:
                    seen.update(set(TERM.findall(t.lower())))
                elif text_hash not in met:
                    met[text_hash] = {w for w in TERM.findall(t.lower()) if wanted(w)}
            out = [(None, w, k) for w, k in seen.items() if wanted(w)] + [(h, w, 1) for h, ws in met.items() for w in ws]
            yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64()))], ["hash", "term", "k"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    every = docs.select(text.alias("text"), F.xxhash64(text).alias("hash")).mapInArrow(count, "hash long, term string, k long")
    once = every.groupBy("hash", "term").agg(F.when(F.col("hash").isNull(), F.sum("k")).otherwise(F.lit(1)).alias("k"))
    return once.groupBy("term").agg(F.sum("k").alias("df"))


def _discloses(texts: int, min_contexts: int, share: float) -> Column:
    """PMI >= share * IC, of columns c, n and df; never where nothing is known of the entity."""
    few = F.col("c") < min_contexts
    p = F.when(few, F.when(2 * F.col("c") >= F.col("n"), F.col("c") / (F.col("df") + SMOOTH))).otherwise(F.least(F.col("c") / F.col("df"), F.lit(1.0)))
    information = -F.log2(F.col("n") / F.lit(float(max(texts, 1))))
    return F.coalesce((F.log2(p) + information >= share * information) & (information > 0), F.lit(False))


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", *, min_contexts: int = MIN_CONTEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """entity, term: the terms that disclose an entity, by itself or by its kind."""
    texts = found.agg(F.count_distinct("hash")).first()[0]
    each = found.select("hash", F.explode("found").alias("f")).select("hash", "f.entity", "f.terms")
    sizes = each.select("entity", "hash").distinct().groupBy("entity").agg(F.count("*").alias("n"))
    met = each.select("entity", "hash", F.explode("terms").alias("term")).distinct()
    near = saved(met.groupBy("entity", "term").agg(F.count("*").alias("c")).join(sizes, "entity"), "near")
    kind = F.substring_index("entity", ":", 1)
    kinds = each.select(kind.alias("kind"), "hash").distinct().groupBy("kind").agg(F.count("*").alias("n"))
    near_kind = met.select(kind.alias("kind"), "hash", "term").distinct().groupBy("kind", "term").agg(F.count("*").alias("c")).join(F.broadcast(kinds), "kind")  # four rows
    df = saved(_frequencies(near.select("term").distinct(), found, docs, text_col), "frequencies")
    discloses = _discloses(texts, min_contexts, disclosed)
    by_kind = near_kind.join(df, "term").where(discloses).groupBy("term").agg(F.collect_set("kind").alias("kinds"))
    every = near.join(df.join(by_kind, "term", "left"), "term")
    by_kind_too = F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    return saved(every.where(discloses | by_kind_too).select("entity", "term"), "disclosing")


def _spark_hash(word: str) -> int:
    """What F.xxhash64 gives for a string, as a number from 0."""
    return xxhash.xxh64_intdigest(word.encode(), 42)


def _with_terms(found: DataFrame, risky: DataFrame) -> DataFrame:
    """``found`` with the disclosing terms of each row's entities."""
    mine = found.select("nr", F.explode(F.array_distinct(F.transform("found", lambda f: f["entity"]))).alias("entity"))
    terms = mine.join(risky.select("entity", "term"), "entity").groupBy("nr").agg(F.collect_set("term").alias("terms"))
    return found.drop("found", "hash").join(terms, "nr", "left")


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = MIN_CONTEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans (kind:start:end, comma-joined, end exclusive)."""
    tune(docs.sparkSession)
    found = _analysed(docs, text_col, [id_col], whole=False)
    risky = disclosing(found, docs, text_col, min_contexts=min_contexts, disclosed=disclosed)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            base, spans = b.column("spans").to_pylist(), []
            for w, t, terms in zip(base, b.column("text").to_pylist(), b.column("terms").to_pylist(), strict=True):
                s = _spans(w)
                spans.append(sorted(s + term_spans(t, set(terms), s)) if terms else s)
            counts = [pa.array([sum(k == i for _, k, _ in s) for s in spans], pa.int64()) for i in range(5)]
            yield pa.record_batch([b.column("doc_id"), *counts, pa.array([hashlib.sha256(w.encode()).hexdigest() for w in base], pa.string()), pa.array(map(_word, spans), pa.string())], names)

    every = _with_terms(found, risky).select(F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), "text", "spans", "terms")
    return every.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string")


def sanitised(docs: DataFrame, *, text_col: str = "text", min_contexts: int = MIN_CONTEXTS, disclosed: float = DISCLOSED) -> DataFrame:
    """``docs`` with entities and disclosing terms replaced in the text; texts without any, and null, stay as they are."""
    tune(docs.sparkSession)
    others = [c for c in docs.columns if c != text_col]
    marked = docs.withColumn("__null", F.col(text_col).isNull())
    found = _analysed(marked, text_col, [f"`{c}`" for c in others] + ["__null"], whole=True)
    risky = disclosing(found, docs, text_col, min_contexts=min_contexts, disclosed=disclosed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            out = []
            for w, t, terms in zip(b.column("spans").to_pylist(), b.column("text").to_pylist(), b.column("terms").to_pylist(), strict=True):
                s = _spans(w)
                out.append(redact(t, s + (term_spans(t, set(terms), s) if terms else [])))
            yield pa.record_batch([b.column("row"), pa.array(out, pa.string())], ["row", "text"])

    every = _with_terms(found, risky).select("row", "text", "spans", "terms")
    clean = every.mapInArrow(run, every.select("row", "text").schema)
    text = F.when(~F.col("row.__null"), F.col("text"))
    return clean.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))

