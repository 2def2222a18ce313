"""Personal data: base spans by pattern, and terms that reveal them by information-theoretic disclosure.

Base entities (email, ip, card, phone) are found by pattern. The corpus then tells which words reveal an
entity: over its distinct texts, ``share`` is the part of a word's texts that hold the entity, and ``g`` the
log-likelihood ratio of word and entity, which entities of any frequency can reach. Words over both disclosure
thresholds, in enough texts with the entity to be evidence, become ``term`` spans wherever they stand in the
corpus; `sanitise` generalises entities to their kind and removes the terms. Work grows with a text's length and
number of spans (times the length of a run of the two-level sums), never with their square.

Defined results: a null text counts as empty; spans are code points, end exclusive, sorted by start, then
kind; repeated rows give equal rows; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.llm.base import once, small_side, staged, text_of

KINDS = ("email", "ip", "card", "phone", "term")
WORD = r"[\p{L}\p{N}]+"
#: A G of 24 has a chance of one in a million without association; as many pairs are tested.
MIN_COUNT, MIN_SHARE, MIN_G = 3, 0.5, 24.0
SPAN = "struct<start:int,kind:int,end:int,value:string,byte_end:int>"
#: Length of the runs of the two-level sums.
BLOCK = 128

#: Possessive quantifiers and look-behinds give the leftmost matches of the plain patterns without their
#: backtracking. The email pattern also takes runs that lead to no address, so they are scanned once.
EMAIL = r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def scan(values: Column, kind: str, step) -> Column:
    """Running values of an array, each with those before it, in two levels: appending to one array copies it every time."""
    empty = F.array().cast(f"array<{kind}>")

    def run(first: Column, own: Column) -> Column:
        add = lambda acc, x: once(step(acc["at"], x), lambda now: F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out")))
        return F.aggregate(own, F.struct(first.alias("at"), empty.alias("out")), add, lambda acc: acc["out"])

    def parts(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK))
        return once(blocks, lambda bs: once(run(F.lit(0).cast(kind), F.transform(bs, lambda x: F.aggregate(x, F.lit(0).cast(kind), step))), lambda ends:
            F.flatten(F.transform(bs, lambda x, b: run(F.when(b == 0, F.lit(0).cast(kind)).otherwise(F.get(ends, b - 1)), x)))))

    return F.when(F.size(values) == 0, empty).otherwise(once(values, parts))


def matches(text: Column, pattern: str, kind: int, ok) -> Column:
    """Spans of the matches that pass ok; lengths of the pieces between them give the places, in code points and in bytes."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # Pieces are paired with matches before the sums, so the text is split once.
    paired = F.filter(F.arrays_zip(pieces.alias("piece"), found.alias("match")), lambda z: z["match"].isNotNull())
    ends = lambda size, both: scan(F.transform(both, lambda z: size(z["piece"]) + size(z["match"])), "int", lambda a, x: a + x)

    def spans(both: Column) -> Column:
        placed = F.arrays_zip(both.alias("z"), ends(F.length, both).alias("end"), ends(F.octet_length, both).alias("byte_end"))
        return F.transform(F.filter(placed, lambda x: ok(x["z"]["match"])), lambda x: F.struct(
            (x["end"] - F.length(x["z"]["match"])).alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["z"]["match"].alias("value"), x["byte_end"].alias("byte_end")))

    return once(paired, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """14 to 19 digits whose weighted sum ends in 0."""
    figures = F.reverse(F.filter(F.split(_digits(m), ""), lambda c: c != ""))
    weighed = F.transform(figures, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + (2 * c.cast("int") / 10).cast("int")))
    total = F.aggregate(weighed, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(_digits(m)).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start and kind."""
    small = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    email = F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, 0, lambda m: F.contains(m, F.lit("@")))).otherwise(_none())
    dotted = F.when(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP, 1, lambda m: m.rlike(rf"^{small}(?:\.{small}){{3}}$"))).otherwise(_none())
    card = F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), matches(text, CARD, 2, _luhn)).otherwise(_none())
    phone = F.when(F.contains(text, F.lit("+")), matches(text, PHONE, 3, lambda m: F.length(_digits(m)).between(10, 15))).otherwise(_none())
    return F.array_sort(F.concat(email, dotted, card, phone))


def rebuilt(text: Column, spans: Column, put) -> Column:
    """The text with put(span, code points of it that no span before covers) in place of what its sorted spans cover."""

    def parts(raw: Column, own: Column) -> Column:
        ends, covered = (scan(own[c], "int", lambda a, x: F.greatest(a, x)) for c in ("byte_end", "end"))
        placed = F.arrays_zip(own.alias("s"), ends.alias("to"), covered.alias("upto"))

        def piece(all_: Column, x: Column, i: Column) -> Column:
            before, upto = (F.when(i == 0, F.lit(0)).otherwise(F.get(all_, i - 1)[c]) for c in ("to", "upto"))
            start = x["s"]["byte_end"] - F.octet_length(x["s"]["value"])
            between = F.substring(raw, before + 1, F.greatest(start - before, F.lit(0))).cast("string")
            return F.concat(between, put(x["s"], F.greatest(x["s"]["end"] - F.greatest(x["s"]["start"], upto), F.lit(0))))

        rest = lambda all_: F.substring(raw, F.get(all_, F.size(all_) - 1)["to"] + 1, F.octet_length(raw)).cast("string")
        return once(placed, lambda all_: F.concat(F.array_join(F.transform(all_, lambda x, i: piece(all_, x, i)), ""), rest(all_)))

    return F.when(F.size(spans) == 0, text).otherwise(once(F.struct(text.cast("binary").alias("raw"), spans.alias("own")), lambda v: parts(v["raw"], v["own"])))


def blanked(text: Column, base: Column) -> Column:
    """The text with blanks for its base spans; places stay as they are."""
    return rebuilt(text, base, lambda s, n: F.repeat(F.lit(" "), n))


def _words(plain: str) -> Column:
    """Each distinct word of a text, a row."""
    return F.explode(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(WORD), F.lit(0)), F.lower))).alias("term")


def association(together: Column, n_term: Column, n_entity: Column, n: Column) -> Column:
    """Log-likelihood ratio (G) of a word and an entity over n texts, against independence."""
    cells = [(together, n_term, n_entity), (n_term - together, n_term, n - n_entity), (n_entity - together, n - n_term, n_entity), (n - n_term - n_entity + together, n - n_term, n - n_entity)]
    return sum((F.when(seen > 0, 2 * seen * F.log(seen * n / (row * column))).otherwise(0.0) for seen, row, column in cells), F.lit(0.0))


def telling_terms(own: DataFrame, found: DataFrame, min_count: int, min_share: float, min_g: float) -> DataFrame:
    """The words (term) that reveal an entity, with the entity. All counts are of distinct texts."""
    copies = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"))
    n_texts = copies.count()
    held = found.select("text_key", F.explode(F.array_distinct(F.transform("base", lambda b: F.xxhash64(b["kind"], b["value"])))).alias("entity")).distinct()
    by_entity = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= min_count)
    held = staged(held.join(small_side(by_entity), "entity"), "held")
    near = own.join(small_side(held.select("text_key").distinct()), "text_key", "left_semi").select("text_key", _words("plain")).distinct()
    pairs = near.join(held, "text_key").groupBy("term", "entity", "n_entity").agg(F.count(F.lit(1)).alias("together"))
    pairs = staged(pairs.filter(F.col("together") >= min_count), "pairs")
    # Rows of a text that has copies count as parts of one.
    rows = own.join(small_side(copies.filter("copies > 1")), "text_key", "left").select(F.coalesce(1.0 / F.col("copies"), F.lit(1.0)).alias("part"), _words("plain"))
    counts = rows.join(small_side(pairs.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.round(F.sum("part")).alias("n_term"))
    pairs = pairs.join(counts, "term")
    g = association(F.col("together"), F.col("n_term"), F.col("n_entity"), F.lit(float(n_texts)))
    return staged(pairs.filter((F.col("together") / F.col("n_term") >= min_share) & (g >= min_g)).select("term", "entity"), "telling")


def detect(docs: DataFrame, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE, min_g: float = MIN_G) -> DataFrame:
    """doc_id, text_key, base, spans (base and term spans) for every row of docs."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    own = own.withColumn("text_key", F.xxhash64("text", F.length("text")))
    found = staged(own.select("doc_id", "text_key", base_spans(F.col("text")).alias("base")), "entities")
    own = own.select("doc_id", "text_key", once(base_spans(F.col("text")), lambda base: blanked(F.col("text"), base)).alias("plain"))

    telling = telling_terms(own, found, min_count, min_share, min_g)
    # Every occurrence of a telling word, wherever in the corpus.
    marked = own.select("doc_id", "text_key", _words("plain")).join(small_side(telling.select("term").distinct()), "term", "left_semi")
    marked = staged(marked.groupBy("doc_id", "text_key").agg(F.collect_set("term").alias("terms")).withColumnsRenamed({"doc_id": "m_id", "text_key": "m_key"}), "marked")
    added = own.join(marked, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("text_key") == F.col("m_key")))
    added = added.select(F.col("doc_id").alias("a_id"), F.col("text_key").alias("a_key"), matches(F.col("plain"), WORD, 4, lambda m: F.array_contains("terms", F.lower(m))).alias("added")).dropDuplicates(["a_id", "a_key"])
    out = found.join(added, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_key") == F.col("a_key")), "left")
    return out.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", F.coalesce("added", _none()))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs (doc_id, text) with clean_text: entities become their kind in angle brackets, revealing terms go."""
    found = detect(docs, **thresholds).dropDuplicates(["doc_id", "text_key"])
    found = found.select(F.col("doc_id").alias("_s_id"), F.col("text_key").alias("_s_key"), F.col("spans").alias("_s_spans"))
    both = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_s_id")) & (F.xxhash64(text_of(), F.length(text_of())) == F.col("_s_key")), "left")
    names = F.array(*map(F.lit, KINDS))
    # A span that lies within those before it leaves nothing, not even its kind.
    whole = rebuilt(text_of(), F.coalesce("_s_spans", _none()), lambda s, n: F.when((s["kind"] == 4) | (n == 0), F.lit("")).otherwise(F.concat(F.lit("<"), F.get(names, s["kind"]), F.lit(">"))))
    return both.select(*[c for c in docs.columns if c != "clean_text"], whole.alias("clean_text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
