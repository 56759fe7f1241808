"""PII: pattern spans, and information-theoretic sanitisation of terms that reveal protected entities.

Emails, IP addresses, card and phone numbers are found in every whole text by scanners that take time in proportion
to the text. Each distinct value found is a protected entity. Which terms reveal one is estimated from the corpus: a
term t (a lower-cased word of any length; of scripts that set no spaces, each two letters that follow one another)
that stands in a text with entity e, however far off, is scored by

    PMI(e; t) / IC(e) = log(p(e, t) / (p(e) p(t))) / -log p(e),

with probabilities over all texts of the corpus; copies of one text count as one text everywhere, so what merely was
copied along is no disclosure. A term that scores TERM_GENERALISED or more is generalised, and removed from
TERM_REMOVED on, wherever it occurs in a text that holds the entity; no number of texts is asked for. Only pairs that
chance alone may bring together are no evidence: that n(t) and n(e) texts of N have `both` texts in common has at most
the probability (n(t) n(e) / N)^both / both!, and a pair where this bound is above CHANCE is left out. So one common
text tells nothing in a corpus of a few dozen texts, but does in all larger ones if term and entity are rare in them.
p(t) counts all texts that hold the term; for that, documents are scanned again for the terms of texts with
entities (a fixed-size Bloom filter passes over most others, and a join decides).

Terms and entities are kept by text, and meet by key. As p(e, t) is p(e) at most, a term in more than
of_entity^g * texts^(1 - g) texts (g = TERM_GENERALISED) cannot score enough, and is left out before they meet, which
changes no result. Entities that lie in the same texts score alike and are one class: a text that lists many entities
is met once by each class, not by each of them. Counts have partial sums before each shuffle; no list of entities or
terms reaches the driver or a single task.

Defined results: a null text is an empty one and has no spans; equal rows get equal spans; overlaps between kinds all
are listed, and are replaced together in the sanitised text; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pixelweave.llm.common import batches_of, tidy, written

#: In the order in which spans with equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
BASE = KINDS[:4]
CHANCE, TERM_GENERALISED, TERM_REMOVED = 0.01, 0.75, 0.9
#: Bits of a filter (a power of two), whatever the number of terms; parts in which it is put together; texts that a
#: task remembers to pass over copies.
FILTER_BITS, PARTS, REMEMBERED = 1 << 23, 64, 200_000
#: Characters of texts' terms (and 100 for each text) up to which they are broadcast; texts meet them by a shuffle beyond.
BROADCAST_CHARS = 16_000_000

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
# fixed values: scripts that set no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han)
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003134f"
WORDS = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]+")
RUN = re.compile(f"[{UNSPACED}]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern kinds, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return sorted(found)


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def entity_of(text: str, span: tuple[int, int, int]) -> str:
    a, kind, b = span
    return KINDS[kind] + " " + (re.sub(r"[ ().-]", "", text[a:b].lower()) if kind else text[a:b].lower())


def terms_at(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every term outside the spans of base, in order."""
    k, until = 0, 0
    for m in WORDS.finditer(text):
        a, b = m.span()
        for x in range(a, max(a + 1, b - 1)) if b - a > 2 and RUN.match(text, a) else (a,):
            y = min(b, x + 2) if RUN.match(text, x) else b
            while k < len(base) and base[k][0] < y:  # of the spans that start before the term's end, the farthest end
                until = max(until, base[k][2])
                k += 1
            if until <= x:
                yield text[x:y].lower(), x, y


def terms_in(text: str) -> set[str]:
    """All terms of a text."""
    if text.isascii():
        return set(WORDS.findall(text.lower()))
    found = set()
    for w in set(WORDS.findall(text)):
        found.update((w[k : k + 2].lower() for k in range(max(1, len(w) - 1))) if RUN.match(w) else (w.lower(),))
    return found


def term_spans(text: str, removed: list[str] | None, generalised: list[str] | None) -> list[str]:
    """The spans of a text's condemned terms, at each of their occurrences."""
    kinds = dict.fromkeys(generalised if generalised is not None else (), "generalise") | dict.fromkeys(removed if removed is not None else (), "remove")
    return [f"{kinds[t]}:{a}:{b}" for t, a, b in terms_at(text, base_spans(text)) if t in kinds] if kinds else []


def _slots(key: str | bytes) -> tuple[int, int, int]:
    h = int.from_bytes(hashlib.blake2b(key if isinstance(key, bytes) else key.encode("utf-8", "surrogatepass"), digest_size=12).digest(), "big")
    return h % FILTER_BITS, (h >> 32) % FILTER_BITS, (h >> 64) % FILTER_BITS


def digest_of(text: str | Column) -> Column:
    """What tells texts apart; a null text is an empty one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256))


def find(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, spans (of the patterns), entities, digest of the text, text (null where it holds no entity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, entities, kept = [], [], []
            for t in b.column(1).to_pylist():
                mine = base_spans(t) if t else []
                spans.append([f"{KINDS[k]}:{x}:{y}" for x, k, y in mine])
                entities.append(sorted({entity_of(t, x) for x in mine}))
                kept.append(t if mine else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.string())), pa.array(entities, pa.list_(pa.string())), b.column(2), pa.array(kept, pa.string())], names=["doc_id", "spans", "entities", "digest", "text"])

    schema = "doc_id long, spans array<string>, entities array<string>, digest binary, text string"
    return docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), digest_of(text).alias("digest")).mapInArrow(tidy(run), schema)


def filter_of(rows: DataFrame, keys=lambda value: (value,)) -> Broadcast:
    """A Bloom filter (packed) of the keys of all values of a table's only column."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.zeros(FILTER_BITS, bool)
        seen: set[str | bytes] = set()
        for b in batches:
            for value in b.column(0).to_pylist():
                new = [key for key in keys(value) if key not in seen]
                for key in new:
                    for k in _slots(key):
                        mask[k] = True
                seen.update(new)
            if len(seen) > 400_000:
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(np.packbits(mask), PARTS)], pa.binary())], names=["part", "bits"])

    def union(t: pa.Table) -> pa.Table:
        packed = np.zeros(FILTER_BITS // PARTS // 8, np.uint8)
        for x in t.column("bits").to_pylist():
            packed |= np.frombuffer(x, np.uint8)
        return pa.table({"part": t.column("part")[:1], "bits": pa.array([packed.tobytes()], pa.binary())})

    schema = "part int, bits binary"
    parts = {r["part"]: r["bits"] for r in rows.mapInArrow(tidy(fill), schema).groupBy("part").applyInArrow(union, schema).collect()}  # FILTER_BITS in all
    none = bytes(FILTER_BITS // PARTS // 8)
    packed = np.frombuffer(b"".join(bytes(parts.get(k, none)) for k in range(PARTS)), np.uint8)
    return rows.sparkSession.sparkContext.broadcast(packed)


def text_counts(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): texts of the whole corpus, copies taken as one, that hold each term of the texts with entities."""
    wanted = filter_of(found.where("text is not null").select("text"), terms_in)
    repeated = filter_of(found.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, copied = (np.unpackbits(x.value).view(bool) for x in (wanted, repeated))
        maybe: dict[str, bool] = {}
        number: Counter[str] = Counter()
        seen: set[bytes] = set()

        def hit(w: str) -> bool:
            known = maybe.get(w)
            if known is None:
                known = maybe[w] = all(bits[k] for k in _slots(w))
            return known

        def rows(terms: list[str], digests: list[bytes | None], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(digests, pa.binary()), pa.array(n, pa.int64())], names=["term", "digest", "n"])

        def flush() -> pa.RecordBatch:
            mine = [w for w in number if hit(w)]
            out = rows(mine, [None] * len(mine), [number[w] for w in mine])
            number.clear()
            if len(maybe) > 400_000:
                maybe.clear()
            return out

        for b in batches:
            terms, digests = [], []
            for t, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not t:
                    continue
                if not all(copied[k] for k in _slots(digest)):
                    number.update(terms_in(t))
                elif digest not in seen:  # may have copies, in this task or another: its terms are told apart by text
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(digest)
                    mine = [w for w in terms_in(t) if hit(w)]
                    terms += mine
                    digests += [digest] * len(mine)
            if terms:
                yield rows(terms, digests, [1] * len(terms))
            if len(number) > 200_000:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text).alias("text"), digest_of(text).alias("digest")).mapInArrow(tidy(count), "term string, digest binary, n long")
    counted = written(counted, "pii-counts")
    copies = counted.where("digest is not null").select("term", "digest").distinct().select("term", F.lit(1).cast("long").alias("n"))
    return counted.where("digest is null").select("term", "n").unionAll(copies).groupBy("term").agg(F.sum("n").alias("n"))


def text_terms(found: DataFrame, terms: DataFrame) -> DataFrame:
    """(digest, term, n): which of terms (term, n) stand outside the spans of each text with entities."""
    wanted = filter_of(terms.select("term"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(wanted.value).view(bool)
        maybe: dict[str, bool] = {}
        seen: set[bytes] = set()
        for b in batches:
            digests, held = [], []
            for t, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if digest in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(digest)
                for w in {w for w, _, _ in terms_at(t, base_spans(t))}:
                    hit = maybe.get(w)
                    if hit is None:
                        hit = maybe[w] = all(bits[k] for k in _slots(w))
                    if hit:
                        digests.append(digest), held.append(w)
            if len(maybe) > 400_000:
                maybe.clear()
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(held, pa.string())], names=["digest", "term"])

    return found.where("text is not null").select("text", "digest").mapInArrow(tidy(run), "digest binary, term string").distinct().join(terms, "term")


def disclosures(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(digest, removed, generalised): the terms of each text that reveal an entity in it, by what is done to them."""
    held = found.where("text is not null").select("digest", F.explode("entities").alias("entity")).distinct()
    # the texts of an entity as two sums of hashes: entities with equal sums lie in the same texts
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), F.col("digest")))
    entities = held.groupBy("entity").agg(F.count("*").alias("of_entity"), mark(1).alias("c1"), mark(2).alias("c2"))
    classes = written(held.join(entities, "entity").select("digest", "of_entity", "c1", "c2").distinct(), "pii-classes")
    total = found.select("digest").distinct().count()
    n = F.lit(float(max(total, 2)))
    most = lambda of: F.pow(of, F.lit(TERM_GENERALISED)) * F.pow(n, F.lit(1 - TERM_GENERALISED)) * (1 + 1e-9)
    largest = classes.agg(F.max("of_entity")).first()[0] or 0
    light = written(text_counts(docs, found, text).where(F.col("n") <= most(F.lit(float(largest)))), "pii-light")
    near = written(text_terms(found, light).join(classes, "digest").where(F.col("n") <= most(F.col("of_entity"))), "pii-near")
    scored = near.groupBy("c1", "c2", "of_entity", "term", "n").agg(F.count("*").alias("both"))
    information = F.log(n / F.col("of_entity"))
    share = F.log(F.col("both") * n / (F.col("of_entity") * F.col("n"))) / F.when(information > 0, information)
    # the logarithm of the bound, by Stirling's series for both!, which is a little below it
    both = F.col("both").cast("double")
    chance = both * F.log(F.col("of_entity") * F.col("n") / n) - (both * F.log(both) - both + 0.5 * F.log(2 * math.pi * both))
    enough = scored.where(chance <= math.log(CHANCE)).withColumn("share", share).where(F.col("share") >= TERM_GENERALISED)
    bad = enough.select("c1", "c2", "of_entity", "term", (F.col("share") >= TERM_REMOVED).alias("gone"))
    worst = near.join(bad, ["c1", "c2", "of_entity", "term"]).groupBy("digest", "term").agg(F.max("gone").alias("gone"))
    return worst.groupBy("digest").agg(F.collect_list(F.when(F.col("gone"), F.col("term"))).alias("removed"), F.collect_list(F.when(~F.col("gone"), F.col("term"))).alias("generalised"))


def by_text(rows: DataFrame, has: Column, text: str, bad: DataFrame) -> DataFrame:
    """rows with removed and generalised of their texts; rows that surely hold no entity are dealt by row."""
    key = F.coalesce(F.when(has, digest_of(text)), digest_of(F.monotonically_increasing_id()))
    chars = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.length(x) + 20))
    size = bad.agg(F.coalesce(100 * F.count("*") + chars("removed") + chars("generalised"), F.lit(0)).alias("n")).first()["n"]
    terms = bad.withColumnRenamed("digest", "_digest")
    return rows.withColumn("_key", key).join(F.broadcast(terms) if size <= BROADCAST_CHARS else terms, F.col("_key") == F.col("_digest"), "left")


def spans(docs: DataFrame, ident="doc_id", text="text") -> tuple[DataFrame, DataFrame]:
    """(find() of docs, disclosures() of it)."""
    found = written(find(docs, ident, text), "pii-found", rows=500)
    with batches_of(docs.sparkSession, 500):
        return found, written(disclosures(docs, found, text), "pii-terms")


def report(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of docs."""
    found, bad = spans(docs, ident, text)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [term_spans(t, r, g) if t else [] for t, r, g in zip(*(b.column(c).to_pylist() for c in ("text", "removed", "generalised")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("spans"), pa.array(more, pa.list_(pa.string()))], names=["doc_id", "spans", "more"])

    rows = by_text(found, F.col("text").isNotNull(), "text", bad).select("doc_id", "spans", "text", "removed", "generalised")
    rows = rows.mapInArrow(tidy(added), "doc_id long, spans array<string>, more array<string>")
    count = lambda k: F.size(F.filter("spans", lambda s: s.startswith(k + ":"))).cast("long").alias(f"n_{k}")
    place = lambda s: F.split(s, ":")
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), place(s)[0])
    keyed = F.transform(F.concat("spans", "more"), lambda s: F.struct(place(s)[1].cast("long").alias("a"), rank(s).alias("k"), place(s)[2].cast("long").alias("b"), s.alias("s")))
    everything = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["s"]), ",")
    out = rows.select("doc_id", *[count(k) for k in BASE], F.sha2(F.array_join("spans", ","), 256).alias("base_sha256"), everything.alias("spans"))
    return written(out, "pii-report", rows=500)


def replaced(text: str, marks: list[str]) -> str:
    """The text with each span (or run of overlapping ones) replaced: by its kind in brackets, or by nothing."""
    parsed = sorted((int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in marks))
    out, at = [], 0
    k = 0
    while k < len(parsed):
        a, kind, b = parsed[k]
        k += 1
        while k < len(parsed) and parsed[k][0] < b:
            b, kind = max(b, parsed[k][2]), min(kind, parsed[k][1])
            k += 1
        out += [text[at:a], {"remove": "", "generalise": "[TERM]"}.get(KINDS[kind], f"[{KINDS[kind].upper()}]")]
        at = b
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, ident="doc_id", text="text") -> DataFrame:
    """docs with the spans of text replaced; docs' own columns.

    The patterns are found again in each text; spans that the method adds come by the digest of the text, as equal
    texts have equal spans, whatever their ids. Texts without digit or @ hold no entity; they are dealt by row.
    """
    _, bad = spans(docs, ident, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row"), F.col(text).alias("_text"))
    joined = by_text(rows, F.col("_text").rlike("[@0-9]"), "_text", bad)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r, g in zip(*(b.column(c).to_pylist() for c in ("_text", "removed", "generalised"))):
                own = [f"{KINDS[k]}:{x}:{y}" for x, k, y in base_spans(t)] if t else []
                out.append(replaced(t, own + term_spans(t, r, g)) if own else t)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(out, pa.string())], names=["_row", "_text"])

    schema = StructType([joined.schema["_row"], StructField("_text", StringType())])
    new = joined.select("_row", "_text", "removed", "generalised").mapInArrow(tidy(clean), schema)
    out = new.select(*[F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`") for c in docs.columns])
    return written(out, "pii-sanitised", rows=500)
