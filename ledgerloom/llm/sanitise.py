r"""Personal data, and the terms that give it away: information-theoretic sanitisation, in DataFrame functions only.

* Entities: email addresses, IP addresses, card and phone numbers, by pattern (``KINDS``), leftmost non-overlapping
  per kind; matches that fail their kind's test (parts at most 255; Luhn; the number of digits) are dropped, without a retry.
  Two mentions are of one entity if kind and value (letters in lower case; of cards and phones the digits) are equal.
* Terms: runs of letters, digits and other characters beyond ASCII, in lower case (A-Z). A term is near an entity if it stands within
  ``reach`` characters before or after a mention, in whole, with no other mention between or across.
* Counted over all places of the corpus: N, those of all terms; n(t), of a term; n(c), of terms near the entity c; n(c, t), of
  t near c. The pointwise mutual information log(n(c, t) N / (n(c) n(t))) is what t says about c; of the whole information of c,
  log(N / n(c)), that is the share 1 - log(n(t) / n(c, t)) / log(N / n(c)). A term near c whose share is ``disclosure`` or more gives c
  away, if it was seen near c in at least ``support`` different surroundings (else the estimate is chance; copies of a
  passage are one).
* Such a term is generalised to its first ``keep`` letters where the class of all terms that begin so has a smaller share, counted in the same
  way; else it is removed. Mentions are generalised to their kind.

Null and empty texts have no spans. Documents are known by (id, text): repeated rows get the same spans, and each row counts in the
corpus. Null ids are an id. Columns other than id and text are not read; ``sanitised`` keeps all columns. Very long texts cost their
length times a constant; the spans of a text are put in order by Spark, not in one array operation. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, columns_of, stored
from .quality import let

#: Kind: its pattern, written so that no text takes more than linear time: a run of characters is entered at its beginning only
#: (or right after a match), and repetitions that nothing follows don't give back.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A quick sign that a text may hold the kind.
SIGNS = {"email": "@", "phone": "+"}
TERM_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"
BLOCK = 256


def running(lengths: Column) -> Column:
    """The sum of the elements before each one; in blocks, so that long arrays don't cost their square."""
    def total(a):
        return F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def sums(blocks):
        return let(F.transform(blocks, total), lambda of: F.flatten(F.transform(blocks, lambda x, b: let(
            total(F.slice(of, F.lit(1), b)), lambda o: F.transform(x, lambda _, i: o + total(F.slice(x, F.lit(1), i)))))))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")),
                           lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))), sums)


def places(text: Column, pattern: str, test=None) -> Column:
    """(start, value) of every match."""
    return let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), lambda m: let(
        running(F.transform(m["found"], lambda x, i: F.length(x) + F.length(m["between"][i]))), lambda before: F.filter(
            F.transform(m["found"], lambda x, i: F.struct((before[i] + F.length(m["between"][i])).alias("start"), x.alias("value"))),
            lambda x: F.lit(True) if test is None else test(x["value"]))))


def digits(value: Column) -> Column:
    return F.translate(value, " -().+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of card numbers."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: let(
        d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x) % 10 == 0


TESTS = {
    "email": None,
    "ip": lambda v: v.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"),
    "card": lambda v: luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(10, 15),
}


def mentions(text: Column) -> Column:
    """(start, kind, end, value) of every entity, by start, then kind (its number in ``KINDS``)."""
    def found(number: int, kind: str, pattern: str) -> Column:
        sign = F.contains(text, F.lit(SIGNS[kind])) if kind in SIGNS else text.rlike(pattern)
        spans = F.transform(places(text, pattern, TESTS[kind]), lambda x: F.struct(
            x["start"].alias("start"), F.lit(number).alias("kind"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))
        return F.when(sign, spans).otherwise(F.array().cast(_SPANS))

    return F.array_sort(F.concat(*[found(k, *x) for k, x in enumerate(KINDS.items())]))


def _surroundings(text: Column, spans: Column, reach: int) -> Column:
    """Of each span also up to ``reach`` + 1 characters before and after it. The text has four bytes a character here, so each place is found at once."""
    def around(wide):
        def cut(start, end):
            return F.decode(F.substring(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")

        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"),
            cut(F.greatest(s["start"] - (reach + 1), F.lit(0)), s["start"]).alias("before"), cut(s["end"], s["end"] + (reach + 1)).alias("after")))

    return let(F.encode(text, "UTF-32"), around)


def near_terms(seen: DataFrame, reach: int) -> DataFrame:
    """id, hash, copies, entity, start, end, term, around: each term near a mention."""
    by = Window.partitionBy("id", "hash").orderBy("start", "end")
    free = seen.withColumns({"from": F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1)), "to": F.lead("start").over(by)})
    room = F.greatest(F.col("start") - F.coalesce("from", F.lit(0)), F.lit(0))
    next_room = F.when(F.col("from") > F.col("end"), 0).otherwise(F.greatest(F.coalesce("to", F.col("end") + reach + 1) - F.col("end"), F.lit(0)))
    free = free.withColumns({"room": room, "next_room": next_room})
    free = free.withColumns({"before": F.expr("right(before, room)"), "after": F.expr("left(after, next_room)")})
    # reach + 1 characters may begin or end inside a term; a side that is shorter is whole
    free = free.withColumns({
        "before": F.when(F.length("before") > reach, F.regexp_replace("before", f"^{TERM_CLASS}++", "")).otherwise(F.col("before")),
        "after": F.when(F.length("after") > reach, F.regexp_replace("after", f"{TERM_CLASS}+$", "")).otherwise(F.col("after"))})
    number = F.when(F.col("kind") >= 2, digits(F.col("value"))).otherwise(ascii_lower(F.col("value")))
    entity = F.concat(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.lit(":"), number)

    def terms(side: str, begin: Column) -> Column:
        return F.transform(places(F.col(side), f"{TERM_CLASS}+"), lambda x: F.struct((begin + x["start"]).alias("start"), x["value"].alias("value")))

    sides = F.concat(terms("before", F.col("start") - F.length("before")), terms("after", F.col("end")))
    around = F.xxhash64(ascii_lower(F.col("before")), ascii_lower(F.col("after")))
    rows = free.select("id", "hash", "copies", entity.alias("entity"), around.alias("around"), F.explode(sides).alias("x"))
    rows = rows.select("id", "hash", "copies", "entity", "around", F.col("x.start").alias("start"),
                       (F.col("x.start") + F.length("x.value")).alias("end"), ascii_lower(F.col("x.value")).alias("term"))
    return rows.groupBy("id", "hash", "entity", "start", "end", "term").agg(F.max("copies").alias("copies"), F.min("around").alias("around"))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """term, n: the places of each term in all texts."""
    words = F.regexp_extract_all(ascii_lower(F.col(f"`{text_col}`")), F.lit(f"{TERM_CLASS}+"), F.lit(0))
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def revealing(near: DataFrame, counts: DataFrame, disclosure: float, support: int, keep: int) -> DataFrame:
    """entity, term, instead: the terms that give the entity away and what stands for each (empty: nothing)."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = near.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    pairs = near.groupBy("entity", "term", "around").agg(F.sum("copies").alias("n")).groupBy("entity", "term").agg(
        F.sum("n").alias("n_both"), F.count("*").alias("seen"))
    begin = F.substring("term", 1, keep)
    classes = counts.groupBy(begin.alias("begin")).agg(F.sum("n").alias("n_class"))
    class_pairs = pairs.groupBy(F.col("entity").alias("of"), begin.alias("with")).agg(F.sum("n_both").alias("n_class_both"))

    def share(n_term, n_both):
        return 1 - F.log(F.col(n_term) / F.col(n_both)) / F.log(F.lit(total) / F.col("n_entity"))

    likely = (pairs.where(F.col("seen") >= support).join(own, "entity").where(F.col("n_entity") < total)
              .join(counts, "term").where(share("n", "n_both") >= disclosure))
    wider = (likely.withColumn("begin", begin).join(classes, "begin")
             .join(class_pairs, (F.col("entity") == F.col("of")) & (F.col("begin") == F.col("with"))))
    instead = F.when((F.length("term") > keep) & (share("n_class", "n_class_both") < disclosure), F.concat("begin", F.lit("*"))).otherwise("")
    return wider.select("entity", "term", instead.alias("instead"))


def find_spans(docs: DataFrame, reach: int = 64, disclosure: float = 0.95, support: int = 3, keep: int = 3,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, hash (of the text), copies (rows of that id and text), spans: (start, kind, end, instead) of all mentions and revealing
    terms, by start, then kind. A row for each id and text."""
    d = columns_of(docs, id_col, text_col).toDF("id", "text")
    text = F.coalesce("text", F.lit(""))
    around = let(mentions(text), lambda m: F.when(F.size(m) > 0, _surroundings(text, m, reach)))
    rows = d.select("id", F.xxhash64(text, F.length(text)).alias("hash"), around.alias("mentions"))
    rows = stored(rows.groupBy("id", "hash").agg(F.count("*").alias("copies"), F.any_value("mentions").alias("mentions")), "op13-mentions")
    seen = rows.where("mentions is not null").select("id", "hash", "copies", F.explode("mentions").alias("m")).select("id", "hash", "copies", "m.*")
    near = stored(near_terms(seen, reach), "op13-near")
    counts = stored(term_counts(d), "op13-terms")
    away = revealing(near, counts, disclosure, support, keep)
    terms = (near.join(away, ["entity", "term"]).groupBy("id", "hash", "start", "end").agg(F.min("instead").alias("instead"))
             .select("id", "hash", F.struct("start", F.lit(len(KINDS)).alias("kind"), "end", "instead").alias("s")))
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    base = seen.select("id", "hash", F.struct("start", "kind", "end", F.element_at(kinds, F.col("kind") + 1).alias("instead")).alias("s"))
    spans = base.unionByName(terms).groupBy("id", "hash").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    out = rows.alias("r").join(spans.alias("p"), F.col("r.id").eqNullSafe(F.col("p.id")) & (F.col("r.hash") == F.col("p.hash")), "left")
    return out.select(F.col("r.id").alias(id_col), F.col("r.hash").alias("hash"), "copies",
                      F.coalesce("spans", F.array().cast("array<struct<start: int, kind: int, end: int, instead: string>>")).alias("spans"))


def sanitised(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``find_spans`` replaced; spans that overlap become the first one's replacement."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    s = found.where(F.size("spans") > 0).select(F.col(id_col).alias("__of"), F.col("hash").alias("__hash"), F.explode("spans").alias("__s"))
    by = Window.partitionBy("__of", "__hash").orderBy("__s")
    s = s.withColumn("__from", F.coalesce(F.max("__s.end").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.groupBy("__of", "__hash").agg(F.array_sort(F.collect_list(F.struct(F.col("__s.start").alias("start"), F.col("__s.kind").alias("kind"),
        F.col("__from").alias("from"), F.col("__s.end").alias("end"), F.col("__s.instead").alias("instead")))).alias("__spans"))

    def replaced(wide):
        def cut(start, end):
            return F.decode(F.substring(wide, 4 * start + 1, 4 * (end - start)), "UTF-32")

        parts = F.transform("__spans", lambda x: F.when(x["start"] >= x["from"], F.concat(cut(x["from"], x["start"]), x["instead"])).otherwise(""))
        last = F.array_max(F.transform("__spans", lambda x: x["end"]))
        return F.concat(F.array_join(parts, ""), cut(last, F.length(t)))

    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{id_col}`").alias("__id"),
                      t.alias("__text"), F.xxhash64(t, F.length(t)).alias("__h"))
    t = F.col("__text")
    out = key.join(s, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__h") == F.col("__hash")), "left")
    new = F.when(F.col("__spans").isNull(), F.col("__row")[text_col]).otherwise(let(F.encode(t, "UTF-32"), replaced))
    return out.select(*[(new if c == text_col else F.col("__row")[c]).alias(c) for c in docs.columns])


def _number(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in [*KINDS, "term"]])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans_report(docs: DataFrame) -> DataFrame:
    """A row for each document: the numbers of mentions, the digest of their places and all spans."""
    found = find_spans(docs)
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    numbers = [_number(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("doc_id", *numbers, F.sha2(_text(base).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))
