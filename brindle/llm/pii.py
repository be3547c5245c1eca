"""Personal data: patterns for protected entities, and information-theoretic sanitisation of the terms that reveal them.

DataFrame functions only. Protected are the entities and the groups they belong to: an address's domain, an IP's network, a card's
issuer, a number's area. Terms beside them are counted with them over the whole corpus. A term t discloses the share
1 - log P(e|t) / log P(e) of the information content of e: none if they are independent, all if t occurs with
e alone. Terms over a threshold, seen with e in more than one text, are spans like the entities and are generalised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, bind, saved, table, text_key

#: Kinds in the order that ties between starts follow; "term" is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
# The same matches as the plain patterns, in linear time: the first run is taken whole, from where it begins or the last match ended.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20\-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9\-]+[0-9]"
_TERM = r"\p{L}{4,}"
#: Matches in a chunk of a text's matches.
_CHUNK = 256
#: Flagged terms, of all documents together, up to which they are broadcast.
FEW = 100_000
_SPAN = "array<struct<start:int,kind:int,end:int,value:string,before:string,after:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's check."""

    def total(d: Column) -> Column:
        digit = lambda i: F.substring(d, i, 1).cast("int")
        twice = lambda i: F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)
        worth = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when((F.length(d) - i) % 2 == 1, twice(i)).otherwise(digit(i)))
        return F.aggregate(worth, F.lit(0), lambda a, x: a + x)

    return bind(_digits(c), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def _octets(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: bind(F.ltrim(p, F.lit("0")), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))


_RULES = (
    (_EMAIL, lambda t: F.contains(t, F.lit("@")), None),
    (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), _octets),
    (_CARD, lambda t: t.rlike(r"[0-9][\x20\-]?[0-9]"), _luhn),
    (_PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: bind(_digits(m), lambda d: F.length(d).between(10, 15))),
)


def _matches(text: Column, kind: int, pattern: str, context: int, valid=None) -> Column:
    """The valid matches of pattern in text: what split() leaves between all of them gives their places in code points. Their
    contexts are the text's own characters on both sides, other matches included. Places are summed in a fold by chunks, so that a text of many matches takes time linear in them."""
    none = F.array().cast(_SPAN)
    first = lambda c: F.left(c, F.lit(context + 1))
    last = lambda c: F.right(c, F.lit(context + 1))

    def fold(x: Column) -> Column:
        found, rest = x["found"], x["rest"]

        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.char_length(F.get(rest, i))
            end = start + F.char_length(F.get(found, i))
            before, after = F.lit(""), F.lit("")
            if context:
                # one character more tells whether the text goes on; pieces and other matches alike belong to the text
                before = last(F.concat(a["tail"], F.get(rest, i)))
                pieces = F.sequence(i + 1, F.least(i + 1 + context // 2, F.size(found)))  # a match has two characters or more
                piece = lambda j: first(F.concat(first(F.get(rest, j)), first(F.coalesce(F.get(found, j), F.lit("")))))
                after = first(F.array_join(F.transform(pieces, piece), ""))
            tail = last(F.concat(before, F.get(found, i))) if context else F.lit("")
            # whole words alone: the cut one at the far end goes
            before = F.when(F.char_length(before) > context, F.regexp_replace(F.right(before, F.lit(context)), r"^\p{L}+", "")).otherwise(before)
            after = F.when(F.char_length(after) > context, F.regexp_replace(F.left(after, F.lit(context)), r"\p{L}+$", "")).otherwise(after)
            one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.get(found, i).alias("value"), before.alias("before"), after.alias("after")))
            out = F.concat(a["out"], one.cast(_SPAN))
            return F.struct(end.alias("at"), tail.alias("tail"), (F.when(valid(F.get(found, i)), out).otherwise(a["out"]) if valid else out).alias("out"))

        def chunk(a: Column, k: Column) -> Column:
            own = F.aggregate(F.sequence(k, F.least(k + _CHUNK, F.size(found)) - 1), F.struct(a["at"].alias("at"), a["tail"].alias("tail"), none.alias("out")), step)
            return bind(own, lambda o: F.struct(o["at"].alias("at"), o["tail"].alias("tail"), F.concat(a["out"], F.array(o["out"])).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{_SPAN}>").alias("out"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(_CHUNK)), start, chunk, lambda a: F.flatten(a["out"]))).otherwise(none)

    return bind(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("rest")), fold)


def _entities(text: Column, context: int) -> Column:
    none = F.array().cast(_SPAN)
    return F.concat(*[F.when(likely(text), _matches(text, kind, pattern, context, valid)).otherwise(none) for kind, (pattern, likely, valid) in enumerate(_RULES)])


def _terms(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(_TERM), F.lit(0)))


def _protected(e: Column) -> Column:
    """What an entity's terms may reveal: its value, and the group it belongs to (domain, network of 256, issuer, area), as structs of kind, level and value."""
    kind, value, digits = e["kind"], F.lower(e["value"]), _digits(e["value"])
    own = F.when(kind >= 2, digits).otherwise(value)
    group = F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 3)).when(kind == 2, F.left(digits, F.lit(6))).otherwise(F.left(digits, F.length(digits) - 7))
    return F.array(*[F.struct(kind.alias("kind"), F.lit(level).alias("level"), v.alias("value")) for level, v in enumerate((own, group))])


def _frequencies(words: DataFrame, wanted: DataFrame) -> DataFrame:
    """term and n_term, the number of different rows (doc_id, row and text) that hold each term wanted. Terms are counted map-side and never move with their rows: a row that stands there
    c times counts c times among the rows of c copies, and the sum over these is divided by c."""
    copies = words.groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    copies = saved(copies.select(F.col("doc_id").alias("c_id"), apart(F.col("row")).alias("c_row"), "copies"))
    n = copies.count()
    told = words.select("doc_id", "row", _terms(F.col("text")).alias("terms"))
    if n:
        told = told.join(F.broadcast(copies) if n <= FEW else copies, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("row") == F.col("c_row")), "left")
    told = told.select(F.explode("terms").alias("term"), (F.coalesce("copies", F.lit(1)) if n else F.lit(1)).cast("long").alias("copies"))
    told = told.join(wanted, "term", "left_semi").groupBy("term", "copies").agg(F.count(F.lit(1)).alias("n"))
    return told.groupBy("term").agg(F.sum(F.expr("n div copies")).alias("n_term"))


def disclosures(base: DataFrame, words: DataFrame, disclosure: float = 0.9, support: int = 2) -> tuple[DataFrame, DataFrame]:
    """The terms beside entities, and which of them reveal which: (doc_id, row, entity, term) of all, (entity, term, share) of those that reach disclosure.

    base has doc_id, row and found, the entities with their contexts; words doc_id, row and text of the same rows. n is the number of rows, n_entity that of rows with
    the entity beside some term, n_term that of rows with the term, n_both that of rows with the term beside the entity: the share disclosed is
    1 - ln(n_both / n_term) / ln(n_entity / n). An entity in all rows has no information to disclose. Rows that agree in doc_id and text count once.
    """
    beside = base.select("doc_id", "row", F.explode("found").alias("e"))
    beside = beside.select("doc_id", "row", F.explode(_protected(F.col("e"))).alias("entity"), _terms(F.concat_ws(" ", "e.before", "e.after")).alias("terms"))
    beside = saved(beside.select("doc_id", "row", "entity", F.explode("terms").alias("term")).distinct())
    n = F.greatest(F.lit(1), F.lit(base.select("doc_id", "row").distinct().count()))
    # seen by rows and by texts: a text's copies say nothing new
    texts = beside.groupBy("entity", "term", "row").agg(F.count(F.lit(1)).alias("n"))
    pairs = saved(texts.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= support))
    owners = beside.select("doc_id", "row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    wanted = pairs.select("term").distinct()
    often = _frequencies(words, F.broadcast(wanted) if wanted.count() <= FEW else wanted.select(F.concat("term", F.lit("")).alias("term")))
    # both joins deal their sides anew, so that a popular entity or term can be split
    known = pairs.join(owners.select(F.struct("entity.kind", "entity.level", "entity.value").alias("entity"), "n_entity"), "entity").join(often.select(F.concat("term", F.lit("")).alias("term"), "n_term"), "term")
    share = 1 - F.ln(F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))) / F.ln(F.col("n_entity") / n)
    return beside, known.where(F.col("n_entity") < n).select("entity", "term", share.alias("share")).where(F.col("share") >= disclosure)


def find_pii(docs: DataFrame, disclosure: float = 0.9, support: int = 2, context: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, row (a hash of the text), spans (structs of start, kind, end, sorted).

    start and end count code points, end exclusive; kind is a place in KINDS. Entities are what the patterns match. A term is a
    run of 4 letters or more, in lower case. It is a span wherever it stands in a text in which it is within context
    characters of an entity of which, or of whose group, it discloses the share disclosure, if support different texts hold both so.

    A null or empty text has no spans. Repeated rows all come back; rows that share a doc_id are judged each by its own
    text. Copies of a text are one text for the support. Other columns are ignored; an empty table gives an empty result.

    Cost: entities are found in one scan and written to the checkpoint folder. Document frequencies of the terms that have support take
    two more scans, one for the ids and hashes of repeated rows and one counted map-side; pairs of terms and entities are as many as the words in contexts, twice. Where the flagged terms of all
    documents are few they are broadcast; beyond that texts that may hold an entity move once, to find the terms in them.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("row"), text.alias("text"))
    base = saved(rows.select("doc_id", "row", _entities(F.col("text"), context).alias("found")))

    beside, revealing = disclosures(base, rows, disclosure, support)
    flagged = beside.join(revealing.select(F.struct("entity.kind", "entity.level", "entity.value").alias("entity"), F.concat("term", F.lit("")).alias("term")), ["entity", "term"], "left_semi")
    flagged = flagged.groupBy("doc_id", "row").agg(F.collect_set("term").alias("terms")).select(F.col("doc_id").alias("t_id"), apart(F.col("row")).alias("t_row"), "terms")
    flagged = saved(flagged)
    few = (flagged.agg(F.sum(F.size("terms"))).first()[0] or 0) <= FEW
    likely = reduce(Column.__or__, [rule(F.col("text")) for _, rule, _ in _RULES])  # no other text has an entity

    bare = "array<struct<start:int,kind:int,end:int>>"
    words = _matches(F.col("text"), KINDS.index("term"), _TERM, 0, lambda m: F.array_contains("terms", F.lower(m)))
    words = F.transform(words, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    own = rows.where(likely).join(F.broadcast(flagged) if few else flagged, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("row") == F.col("t_row"))).select("doc_id", "row", words.alias("words"))
    own = own.dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("w_id"), F.col("row").alias("w_row"), "words")
    found = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = base.join(own, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row") == F.col("w_row")), "left")
    return out.select("doc_id", "row", F.array_sort(F.concat(found.cast(bare), F.coalesce(F.col("words").cast(bare), F.array().cast(bare)))).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id and text for each row of docs: each span stands as its kind, generalised, as in [email]. Of spans that overlap the first counts.

    A null text becomes an empty one. Repeated rows all come back, as do null ids. Other columns are left out, whatever their names; an empty table gives an empty
    result. Texts move once, to their spans.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("row"), text.alias("text"))
    spans = find_pii(docs, id_col=id_col, text_col=text_col, **options).dropDuplicates(["doc_id", "row"])
    spans = spans.select(F.col("doc_id").alias("s_id"), F.col("row").alias("s_row"), "spans")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(
        s["start"] >= a["at"],
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.get(names, s["kind"])).alias("out")),
    ).otherwise(a)
    clean = F.aggregate("spans", none, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("row") == F.col("s_row")))
    return joined.select("doc_id", clean.alias("text"))


def _told(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents"))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("term"))
    return out.select("doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("spans")).alias("spans"))
