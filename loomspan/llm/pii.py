"""Personal data: base patterns, and information-theoretic sanitisation of the words beside them. DataFrame functions only.

Base spans are emails, IP addresses, payment cards and phone numbers. Each distinct value is a protected entity. Words
of the same texts may give it away as well: with ``p(e)`` the share of texts that hold the entity, ``IC(e) = -log2 p(e)``
is what naming it tells, and ``PMI(t; e) = log2(p(t | e) / p(t))`` what the term tells about it, from the share of the
entity's texts and of all texts that hold the term. ``p(t | e)`` is smoothed: ``support`` further texts are added to the
entity's, with the term as often as anywhere, so that few texts show less. A term that tells ``remove`` of an entity's
information content or more is removed wherever it stands in a text with the entity, one that tells ``generalise`` or
more is replaced by its class. Equal texts that hold an entity count once everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspan.operators.tables import settled, written

KINDS = ("email", "ip", "card", "phone")
#: Starts and endings are tied down so that Java's matcher neither recurses nor tries a run of characters twice; the
#: matches are those of the plain patterns. \G lets a match follow the one before.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a term is made of.
WORD = r"[\p{L}\p{M}]+"


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of all matches, in code points: each match is taken with the gap before it."""
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    gaps, hits = F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2))
    steps = F.zip_with(gaps, hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")

    def step(acc, x):
        start = acc["pos"] + x["gap"]
        end = start + F.char_length(x["hit"])
        return F.struct(end.alias("pos"), F.when(x["hit"] == "", acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"))))).alias("found"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("pos"), none.alias("found")), step, lambda acc: acc["found"])


def _luhn(digits: Column) -> Column:
    r = F.reverse(digits)

    def add(acc, i):
        d = F.substring(r, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str):
    def check(x):
        hit = x["hit"]
        digits = F.regexp_replace(hit, "[^0-9]", "")
        if kind == "ip":
            return F.forall(F.split(hit, r"\."), lambda p: (F.char_length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
        if kind == "card":
            return F.char_length(digits).between(12, 19) & _luhn(F.substring(digits, 1, 19))
        if kind == "phone":
            return F.char_length(digits).between(9, 15)
        return F.lit(True)

    return check


def _ranked(rank: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))


def _is(kind: str):
    return lambda x: x["kind"] == kind


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end, kind, hit>> of a text's base spans by start, then kind as in ``KINDS``.

    Per kind: leftmost matches that do not overlap; matches that fail a kind's check go. Null and empty texts have none.
    """
    text = F.coalesce(text, F.lit(""))
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.contains("+")}
    parts = []
    for rank, kind in enumerate(KINDS):
        found = F.filter(_matches(text, PATTERNS[kind]), _valid(kind))
        full = F.transform(found, _ranked(rank, kind))
        parts.append(F.when(needs[kind], full).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int,kind:string,hit:string>>)")))
    return F.array_sort(F.concat(*parts))


def _terms(text: Column) -> Column:
    """The distinct terms of three letters or more of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{M}]+")), lambda w: F.char_length(w) >= 3)


def document_frequency(docs: DataFrame) -> DataFrame:
    """``(h, df)``: for each term of three letters or more, by hash, the number of documents that hold it."""
    each = docs.select(F.explode(_terms(F.col("text"))).alias("term"))
    return each.groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("df"))


def _told(both: Column, texts: Column, df: Column, total: int, support: int) -> Column:
    """Share of an entity's information content that a term tells, from the texts with both, with the entity and with the term."""
    share = (both + support * df / F.lit(float(total))) / (texts + support)
    content = F.log2(F.lit(float(total)) / texts)
    return F.when(content > 0, F.log2(share * F.lit(float(total)) / df) / content).otherwise(0.0)


def _places(texts: DataFrame) -> DataFrame:
    """``(d, term, start, end)`` of all words of the texts ``(d, text)``, in code points."""
    whole = F.lit(rf"(?s)(.*?)(?:({WORD})|\z)")
    steps = F.arrays_zip(F.regexp_extract_all("text", whole, F.lit(1)).alias("gap"), F.regexp_extract_all("text", whole, F.lit(2)).alias("hit"))
    each = texts.select("d", F.posexplode(steps).alias("pos", "x")).select("d", "pos", F.char_length("x.gap").alias("gap"), F.col("x.hit").alias("hit"))
    end = F.sum(F.col("gap") + F.char_length("hit")).over(Window.partitionBy("d").orderBy("pos")).cast("int")
    return each.select("d", F.lower("hit").alias("term"), (end - F.char_length("hit")).alias("start"), end.alias("end"))


def _added(docs: DataFrame, based: DataFrame, generalise: float, remove: float, support: int) -> DataFrame:
    """``(d, added)``: for each distinct text with base spans, by hash, the places of the terms that give an entity of it away, also those inside base spans."""
    held = based.where(F.size("base") > 0).select("text", F.xxhash64("text").alias("d"), F.array_distinct(F.transform("base", lambda x: F.lower(x["hit"]))).alias("entities"))
    once = written(held.groupBy("d").agg(F.first("text").alias("text"), F.first("entities").alias("entities"), (F.count("*") - 1).alias("copies")), "held")
    total = based.count() - int(once.agg(F.sum("copies")).first()[0] or 0)
    names = once.select("d", F.explode("entities").alias("entity"))
    names = names.join(names.groupBy("entity").agg(F.count("*").alias("texts")), "entity")
    terms = once.select("d", "copies", F.explode(_terms(F.col("text"))).alias("term")).withColumn("h", F.xxhash64("term"))
    spare = terms.where("copies > 0").groupBy("h").agg(F.sum("copies").alias("spare"))
    frequency = document_frequency(docs).join(spare, "h", "left").select("h", (F.col("df") - F.coalesce("spare", F.lit(0))).alias("df"))
    terms = terms.join(frequency, "h").select("d", "term", "df")
    told = lambda both: _told(both, F.col("texts"), F.col("df"), total, support)
    # A term tells most if all of the entity's texts hold it: pairs that would tell too little even so are never counted.
    pairs = written(names.join(terms, "d").where(told(F.col("texts")) >= generalise), "pairs")
    judged = pairs.groupBy("entity", "term", "texts", "df").agg(F.count("*").alias("both")).select("entity", "term", told(F.col("both")).alias("told")).where(F.col("told") >= generalise)
    kind = F.when(F.max("told") >= remove, "reveal").otherwise("term")
    marked = written(pairs.join(judged, ["entity", "term"]).groupBy("d", "term").agg(kind.alias("kind")), "marked")
    places = _places(once.join(marked.select("d").distinct(), "d", "left_semi").select("d", "text"))
    return places.join(marked, ["d", "term"]).groupBy("d").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))


def find(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, carry: tuple[str, ...] = (), generalise: float = 0.6, remove: float = 0.8, support: int = 3) -> DataFrame:
    """``(id, base, added[, text][, columns of carry])``: per row the base spans and the spans that the method adds.

    ``base`` is as from ``base_spans``; ``added`` holds ``struct<start, end, kind>`` with kind ``term`` (generalise) or
    ``reveal`` (remove), by start, none inside a base span. Null and empty texts have none. Repeated rows and null ids
    stay; other columns are not read.
    """
    docs = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    based = docs.withColumn("key", F.monotonically_increasing_id()).withColumn("base", base_spans(F.col("text")))
    based = written(based if keep_text else based.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "base")  # keys are fixed here

    held = based.where(F.size("base") > 0)
    spans = settled(documents.sparkSession, lambda: _added(docs, based, generalise, remove, support), "spans")
    of_key = held.select("key", F.xxhash64("text").alias("d")).join(spans, "d").select("key", "added")
    # Rows without base spans have no others: their texts need no shuffle.
    none = F.lit(None).cast("array<struct<start:int,end:int,kind:string>>")
    out = held.join(of_key, "key", "left").unionByName(based.where(F.size("base") <= 0).withColumn("added", none))
    inside = lambda a: F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)")
    out = out.withColumn("added", F.coalesce(F.filter("added", lambda a: ~inside(a)), empty))
    return out.select("id", "base", "added", *(["text"] if keep_text else []), *carry)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    every = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))), F.transform("added", lambda x: F.struct(x["start"].alias("start"), F.lit(9).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("id", *counts, F.sha2(F.concat_ws(",", F.transform("base", show)), 256).alias("base_sha256"), F.concat_ws(",", F.transform(every, show)).alias("spans"))


def sanitised(found: DataFrame) -> DataFrame:
    """The found rows, without spans, and ``text`` with base spans replaced by their kind in brackets, terms by ``[TERM]``, revealing terms by nothing. Of overlapping spans the first counts."""
    every = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("to"))), F.transform("added", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["kind"] == "term", "[TERM]").otherwise("").alias("to")))))

    def step(acc, x):
        kept = F.substring(F.col("text"), acc["pos"] + 1, x["start"] - acc["pos"])
        return F.when(x["start"] < acc["pos"], acc).otherwise(F.struct(x["end"].alias("pos"), F.concat(acc["out"], kept, x["to"]).alias("out")))

    done = F.aggregate(every, F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["pos"] + 1, F.char_length("text"))))
    return found.withColumn("text", F.when(F.size(every) > 0, done).otherwise(F.col("text"))).drop("base", "added")
